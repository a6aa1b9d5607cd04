"""Chat exports to transcripts, chunks and rooms.

A transcript has each user message on a line that begins with ``> ``, then the reply, then a
blank line. Exports of five kinds are recognised; parsing trees and turn-taking by speaker
is sequential within one file and runs in an Arrow-batched function, all else is columns.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.lexicon import ROOM_KEYWORDS
from memloom.functions.text import SPACE, col, count_contained, let, md5_prefix, once, trim

#: Chunks must be longer than this, in characters.
LEAST_CHUNK = 30


# ── Rendering ────────────────────────────────────────────────────────────────


def render_transcripts(messages: DataFrame, key: str) -> DataFrame:
    """messages (key, ord, role, text), roles user and assistant -> (key, transcript, n_messages).

    A reply directly after a user message belongs to it; every such unit ends with a blank line.
    """
    before = Window.partitionBy(key).orderBy("ord")
    answers = (F.col("role") == "assistant") & F.coalesce(F.lag("role").over(before) == "user", F.lit(False))
    line = F.when(F.col("role") == "user", F.concat(F.lit("> "), "text")).otherwise(F.col("text"))
    parted = messages.select(key, "ord", line.alias("line"), answers.alias("answers"))
    lines = F.array_sort(F.collect_list(F.struct("ord", "answers", "line")))
    out = parted.groupBy(key).agg(lines.alias("lines"))
    body = F.transform("lines", lambda x, i: F.concat(F.when(i == 0, "").when(x["answers"], "\n").otherwise("\n\n"), x["line"]))
    return out.select(key, F.concat(F.array_join(body, ""), F.lit("\n")).alias("transcript"), F.size("lines").cast("long").alias("n_messages"))


def count_quotes(text: Column) -> Column:
    """Lines that begin with > after white space."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: trim(x).startswith(">")))


# ── Chat exports ─────────────────────────────────────────────────────────────


def _content(x: object) -> str:
    if isinstance(x, str):
        return x.strip()
    if isinstance(x, list):
        texts = [i if isinstance(i, str) else (i.get("text") or "") for i in x if isinstance(i, str) or isinstance(i, dict) and i.get("type") == "text"]
        return " ".join(texts).strip()
    return str(x.get("text") or "").strip() if isinstance(x, dict) else ""


_ROLES = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant"}


def _by_role(items: object) -> list[tuple[str, str]]:
    found = [(_ROLES.get(i.get("role")) if isinstance(i.get("role"), str) else None, _content(i.get("content"))) for i in items if isinstance(i, dict)] if isinstance(items, list) else []
    return [(r, t) for r, t in found if r and t]


def _json_lines(content: str) -> list[dict]:
    out = []
    for line in content.strip().split("\n"):
        try:
            entry = json.loads(line)
        except ValueError:
            continue
        if isinstance(entry, dict):
            out.append(entry)
    return out


def parse_session_lines(content: str) -> list[tuple[str, str]]:
    """JSON lines with type human, user or assistant and message.content."""
    out = []
    for e in _json_lines(content):
        role = {"human": "user", "user": "user", "assistant": "assistant"}.get(e.get("type")) if isinstance(e.get("type"), str) else None
        text = _content(e["message"].get("content")) if isinstance(e.get("message"), dict) else ""
        if role and text:
            out.append((role, text))
    return out


def parse_event_lines(content: str) -> list[tuple[str, str]]:
    """JSON lines of events; only if one of them is session_meta."""
    entries, out = _json_lines(content), []
    if not any(e.get("type") == "session_meta" for e in entries):
        return []
    for e in entries:
        said = e.get("payload") if e.get("type") == "event_msg" else None
        if isinstance(said, dict) and isinstance(said.get("message"), str) and said["message"].strip():
            role = {"user_message": "user", "agent_message": "assistant"}.get(said.get("type"))
            if role:
                out.append((role, said["message"].strip()))
    return out


def parse_flat(data: object) -> list[tuple[str, str]]:
    """A list of messages, an object that has one, or a list of conversations with chat_messages."""
    if isinstance(data, dict):
        data = next((data[k] for k in ("messages", "chat_messages") if data.get(k) is not None), [])
    if not isinstance(data, list) or not data:
        return []
    if isinstance(data[0], dict) and "chat_messages" in data[0]:
        return [m for c in data if isinstance(c, dict) for m in _by_role(c.get("chat_messages"))]
    return _by_role(data)


def parse_tree(data: object) -> list[tuple[str, str]]:
    """An object whose mapping links nodes: from the root along every first child."""
    nodes = data.get("mapping") if isinstance(data, dict) else None
    if not isinstance(nodes, dict):
        return []
    roots = [(k, n) for k, n in nodes.items() if isinstance(n, dict) and n.get("parent") is None]
    at = next((k for k, n in roots if not n.get("message")), roots[0][0] if roots else None)
    out, seen = [], set()
    while at in nodes and at not in seen:
        seen.add(at)
        message = nodes[at].get("message") or {}
        role = (message.get("author") or {}).get("role")
        parts = (message.get("content") or {}).get("parts") or []
        text = " ".join(p for p in parts if isinstance(p, str) and p).strip()
        if role in ("user", "assistant") and text:
            out.append((role, text))
        at = next(iter(nodes[at].get("children") or []), None)
    return out


def parse_channel(data: object) -> list[tuple[str, str]]:
    """Channel messages: the first speaker is the user; a new one answers if the user spoke last, else is a user too."""
    roles: dict[str, str] = {}
    last, out = None, []
    for item in data if isinstance(data, list) else []:
        if not isinstance(item, dict) or item.get("type") != "message":
            continue
        who = item.get("user") if item.get("user") is not None else item.get("username") or ""
        text = (item.get("text") or "").strip()
        if not text or not who:
            continue
        if who not in roles:
            roles[who] = "assistant" if roles and last == "user" else "user"
        last = roles[who]
        out.append((last, text))
    return out


def parse_export(content: str) -> list[tuple[str, str]]:
    """The messages of the first kind of export that yields at least two, else none."""
    for parse in (parse_session_lines, parse_event_lines):
        if len(found := parse(content)) >= 2:
            return found
    try:
        data = json.loads(content)
    except ValueError:
        return []
    return next((found for parse in (parse_flat, parse_tree, parse_channel) if len(found := parse(data)) >= 2), [])


def transcript_of(messages: list[tuple[str, str]]) -> str:
    units, before = [], None
    for role, text in messages:
        if role == "assistant" and before == "user":
            units[-1] += f"\n{text}"
        else:
            units.append(f"> {text}" if role == "user" else text)
        before = role
    return "\n\n".join(units) + "\n"


def normalize(files: DataFrame, *, by_extension: bool = True) -> DataFrame:
    """files (path, content, ...) with content as a transcript where it is a chat export.

    Blank contents, contents with three quoted lines or more, and what no parser knows stay
    as they are. Only what looks like JSON is handed to the parsers.
    """
    head = F.substring(trim("content"), 1, 1)
    looks = head.isin("{", "[")
    if by_extension:
        looks = looks | F.lower("path").rlike(r"\.jsonl?$")
    tried = F.coalesce(looks & (F.length(trim("content")) > 0) & (count_quotes(F.col("content")) < 3), F.lit(False))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for i in x.index[x["tried"]]:
                if found := parse_export(x.at[i, "content"]):
                    x.at[i, "content"] = transcript_of(found)
            yield x.drop(columns="tried")

    return files.withColumn("tried", tried).mapInPandas(run, files.schema)


# ── Chunks ───────────────────────────────────────────────────────────────────


def chunk_exchanges(files: DataFrame, key: str, text: str = "content") -> DataFrame:
    """(key, chunk_index, content): exchanges where three lines or more are quoted, else paragraphs.

    An exchange is a quoted line and the first eight lines with text after it, up to the next
    quoted line or a rule. Paragraphs are parted by blank lines; a text of more than twenty
    lines in one paragraph is cut into groups of twenty-five lines. Chunks of LEAST_CHUNK
    characters or fewer are left out and the others numbered densely. All steps work on one
    row's own lines, so nothing is shuffled.
    """
    begins = lambda x, mark: x.startswith(mark)
    lines = F.transform(F.split("_body", "\n", -1), lambda x: trim(x))
    step = once(files.select(key, col(text).alias("_body")), {"_lines": lines})
    heads = F.filter(F.transform("_lines", lambda x, i: F.when(begins(x, ">"), i)), lambda i: i.isNotNull())
    step = once(step, {"_heads": heads})

    def reply(after: Column) -> Column:
        stop = F.array_position(F.transform(after, lambda x: begins(x, ">") | begins(x, "---")), F.lit(True))
        said = let(stop, lambda n: F.slice(after, F.lit(1), F.when(n > 0, n.cast("int") - 1).otherwise(F.size(after))))
        return F.array_join(F.slice(F.filter(said, lambda x: x != ""), 1, 8), " ")

    def exchange(i: Column) -> Column:
        said = let(F.slice("_lines", i + 2, F.size("_lines")), reply)
        return F.concat_ws("\n", F.get("_lines", i), let(said, lambda x: F.when(x != "", x)))

    raw = F.split("_body", "\n", -1)
    groups = let(raw, lambda r: F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / 25).cast("int")), lambda g: trim(F.array_join(F.slice(r, g * 25 + 1, 25), "\n"))))
    paragraphs = F.filter(F.transform(F.split("_body", "\n\n"), lambda x: trim(x)), lambda x: x != "")
    prose = let(paragraphs, lambda ps: F.when((F.size(ps) <= 1) & (F.size("_lines") > 20), groups).otherwise(ps))
    step = once(step, {"_parts": F.when(F.size("_heads") >= 3, F.transform("_heads", exchange)).otherwise(prose)})
    long_enough = F.filter("_parts", lambda x: F.length(trim(x)) > LEAST_CHUNK)
    return step.select(key, F.posexplode(long_enough).alias("chunk_index", "content"))


def detect_room(text: Column | str) -> Column:
    """The room with most distinct keywords in the first 3000 characters; ties go to the earlier room, none is ``general``."""
    def best(scores: Column) -> Column:
        top = F.greatest(*(scores[room] for room in ROOM_KEYWORDS))
        out = F.when(top == 0, "general")
        for room in ROOM_KEYWORDS:
            out = out.when(scores[room] == top, room)
        return out

    head = F.lower(F.substring(col(text), 1, 3000))
    return let(let(head, lambda h: F.struct(*(count_contained(h, words).alias(room) for room, words in ROOM_KEYWORDS.items()))), best)


def wing_of(folder: str) -> str:
    """The wing named after a folder."""
    name = [x for x in folder.replace("\\", "/").split("/") if x][-1:] or ["conversations"]
    return "".join("_" if c in " -\t\n" else c for c in name[0].lower())


def mine(files: DataFrame, drawers: DataFrame | None, *, wing: str, agent: str = "loader", now: float = 0.0) -> DataFrame:
    """Files (path, content) not filed yet, as drawers: normalised, chunked and routed, one room a file.

    Files of less than LEAST_CHUNK characters, or without chunks, file nothing.
    """
    if drawers is not None:
        files = files.join(drawers.select(F.col("source_file").alias("path")), "path", "left_anti")
    whole = normalize(files.select("path", "content")).where(F.length(trim("content")) >= LEAST_CHUNK)
    routed = once(whole, {"room": detect_room("content")})
    chunks = chunk_exchanges(routed.withColumn("_key", F.struct("path", "room")), "_key").select("_key.path", "_key.room", "chunk_index", "content")
    return chunks.select(
        F.concat(F.lit(f"drawer_{wing}_"), "room", F.lit("_"), md5_prefix(F.concat("path", F.col("chunk_index").cast("string")), 16)).alias("drawer_id"),
        F.lit(wing).alias("wing"),
        "room",
        "content",
        F.col("path").alias("source_file"),
        "chunk_index",
        F.lit(agent).alias("added_by"),
        F.lit(float(now)).alias("created_at"),
    )


def mining_totals(mined: DataFrame) -> DataFrame:
    """(room, files, drawers)"""
    return mined.groupBy("room").agg(F.countDistinct("source_file").alias("files"), F.count("*").alias("drawers"))


__all__ = ["SPACE", "chunk_exchanges", "detect_room", "mine", "mining_totals", "normalize", "parse_export", "render_transcripts", "transcript_of", "wing_of"]
