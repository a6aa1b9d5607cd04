"""Queries of transcripts, summaries, entities, the registry, layers and checkpoints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import lexicon as X
from memloom.functions.text import once
from memloom.operators import dialect as S
from memloom.operators import entities as E
from memloom.operators import layers as L
from memloom.operators import registry as R
from memloom.operators import transcripts as T
from memloom.operators.drawers import already_filed
from memloom.plans import views
from memloom.plans.catalogue import query
from memloom.plans.views import sql, table
from memloom.streaming.checkpoints import checkpoints, counts_as_message

# ── SQL pieces ───────────────────────────────────────────────────────────────


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words: Sequence[str]) -> str:
    return "[" + ", ".join(map(_q, words)) + "]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _contained_sql(text: str, pairs: Sequence[tuple[str, str]]) -> str:
    cases = ", ".join(f"CASE WHEN contains(lower({text}), {_q(k)}) THEN {_q(c)} END" for k, c in pairs)
    return f"array_to_string(list_filter([{cases}], lambda x, i: x IS NOT NULL AND list_position(list_filter([{cases}], lambda y: y IS NOT NULL), x) IS NOT NULL AND NOT list_contains([{cases}][1:i-1], x))[1:3], '+')"


def _count_sql(text: str, words: Sequence[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {_q(w)}) AS INTEGER)" for w in words) + ")"


# ── Transcripts ──────────────────────────────────────────────────────────────

_TRANSCRIPTS = """m AS (SELECT *, coalesce(role = 'assistant' AND lag(role) OVER (PARTITION BY conv_id ORDER BY ord) = 'user', false) AS answers, row_number() OVER (PARTITION BY conv_id ORDER BY ord) AS nth FROM conv_messages),
    transcripts AS (SELECT conv_id, string_agg(CASE WHEN nth = 1 THEN '' WHEN answers THEN chr(10) ELSE chr(10) || chr(10) END || CASE WHEN role = 'user' THEN '> ' || text ELSE text END, '' ORDER BY ord) || chr(10) AS content, count(*) AS n_messages FROM m GROUP BY conv_id)"""
#: Chunks of any table x (k, content), as CTEs.
_CHUNKS = f"""lines AS (SELECT k, unnest(list_transform(string_split(content, chr(10)), lambda l: {_trim('l')})) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS pos FROM x),
    quoted AS (SELECT k, count(*) FILTER (starts_with(line, '>')) AS quotes, count(*) AS n_lines FROM lines GROUP BY k),
    flow AS (SELECT *, sum(CASE WHEN starts_with(line, '>') THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY pos) AS grp FROM lines JOIN quoted USING (k) WHERE quotes >= 3),
    cut AS (SELECT *, sum(CASE WHEN starts_with(line, '---') THEN 1 ELSE 0 END) OVER (PARTITION BY k, grp ORDER BY pos) AS rules FROM flow WHERE grp > 0),
    kept AS (SELECT *, row_number() OVER (PARTITION BY k, grp ORDER BY pos) AS nth FROM cut WHERE rules = 0 AND line <> ''),
    exchanges AS (SELECT k, grp AS place, max(line) FILTER (nth = 1) || coalesce(chr(10) || string_agg(line, ' ' ORDER BY pos) FILTER (nth BETWEEN 2 AND 9), '') AS content FROM kept GROUP BY k, grp),
    paras AS (SELECT k, list_filter(list_transform(string_split(content, chr(10) || chr(10)), lambda p: {_trim('p')}), lambda p: p <> '') AS ps, string_split(content, chr(10)) AS raw FROM x JOIN quoted USING (k) WHERE quotes < 3),
    paragraphs AS (SELECT k, unnest(range(1, len(ps) + 1)) AS place, unnest(ps) AS content FROM paras WHERE NOT (len(ps) <= 1 AND len(raw) > 20)),
    grouped AS (SELECT k, g AS place, {_trim("array_to_string(raw[g * 25 + 1:g * 25 + 25], chr(10))")} AS content FROM (SELECT k, raw, unnest(range(0, (len(raw) - 1) // 25 + 1)) AS g FROM paras WHERE len(ps) <= 1 AND len(raw) > 20)),
    every AS (SELECT * FROM exchanges UNION ALL SELECT * FROM paragraphs UNION ALL SELECT * FROM grouped),
    chunks AS (SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY place) - 1 AS INTEGER) AS chunk_index, content FROM every WHERE length({_trim('content')}) > 30)"""


def _room_sql(text: str) -> str:
    head = f"lower(substring({text}, 1, 3000))"
    scores = {room: _count_sql(head, words) for room, words in X.ROOM_KEYWORDS.items()}
    best = f"greatest({', '.join(scores.values())})"
    return f"CASE WHEN {best} = 0 THEN 'general' " + " ".join(f"WHEN {s} = {best} THEN '{room}'" for room, s in scores.items()) + " END"


def _transcripts(spark: SparkSession, d: str) -> DataFrame:
    return T.render_transcripts(views.conv_messages(spark, d), "conv_id")


@query(sql("conv_messages", f"WITH {_TRANSCRIPTS} SELECT conv_id, content AS transcript, n_messages FROM transcripts"))
def transcript_render(spark: SparkSession, d: str) -> DataFrame:
    return _transcripts(spark, d)


@query(sql("conv_messages", f"WITH {_TRANSCRIPTS}, x AS (SELECT conv_id AS k, content FROM transcripts), {_CHUNKS} SELECT k AS conv_id, chunk_index, content FROM chunks"))
def chunk_exchange(spark: SparkSession, d: str) -> DataFrame:
    files = _transcripts(spark, d).withColumnRenamed("transcript", "content")
    return T.chunk_exchanges(files, "conv_id")


@query(
    sql("notes", f"WITH x AS (SELECT doc_id AS k, text AS content FROM documents UNION ALL SELECT -1 - user_id, CASE WHEN user_id % 2 = 0 THEN string_agg(text, chr(10) ORDER BY note_id) ELSE string_agg(text, chr(10) || chr(10) ORDER BY note_id) END FROM notes GROUP BY user_id), {_CHUNKS} SELECT k, chunk_index, content FROM chunks")
)
def chunk_paragraph(spark: SparkSession, d: str) -> DataFrame:
    """Documents, and each user's notes on lines or in paragraphs."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("k"), F.col("text").alias("content"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("note_id", "text"))), lambda x: x["text"])
    notes = views.notes(spark, d).groupBy("user_id").agg(ordered.alias("lines"))
    notes = notes.select((-1 - F.col("user_id")).alias("k"), F.when(F.col("user_id") % 2 == 0, F.array_join("lines", "\n")).otherwise(F.array_join("lines", "\n\n")).alias("content"))
    return T.chunk_exchanges(docs.unionAll(notes), "k")


@query(sql("notes", f"SELECT note_id, {_room_sql('text')} AS room FROM notes"))
def detect_room(spark: SparkSession, d: str) -> DataFrame:
    return views.notes(spark, d).select("note_id", T.detect_room("text").alias("room"))


_MINED = f"""{_TRANSCRIPTS}, x AS (SELECT '/chats/' || conv_id || '.txt' AS k, content FROM transcripts WHERE length({_trim('content')}) >= 30), {_CHUNKS}, rooms AS (SELECT k, {_room_sql('content')} AS room FROM x),
    mined AS (SELECT 'drawer_my_chats_' || room || '_' || substring(md5(k || chunk_index), 1, 16) AS drawer_id, 'my_chats' AS wing, room, content, k AS source_file, chunk_index FROM chunks JOIN rooms USING (k))"""


def _chat_files(spark: SparkSession, d: str) -> DataFrame:
    return _transcripts(spark, d).select(F.concat(F.lit("/chats/"), F.col("conv_id").cast("string"), F.lit(".txt")).alias("path"), F.col("transcript").alias("content"))


def _mined(spark: SparkSession, d: str) -> DataFrame:
    return T.mine(_chat_files(spark, d), None, wing=T.wing_of("/home/ann/My Chats"))


@query(sql("conv_messages", f"WITH {_MINED} SELECT * FROM mined"))
def mined_drawers(spark: SparkSession, d: str) -> DataFrame:
    return _mined(spark, d).select("drawer_id", "wing", "room", "content", "source_file", "chunk_index")


@query(sql("conv_messages", f"WITH {_MINED} SELECT room, count(DISTINCT source_file) AS files, count(*) AS drawers FROM mined GROUP BY room"))
def mine_summary(spark: SparkSession, d: str) -> DataFrame:
    return T.mining_totals(_mined(spark, d))


@query("SELECT '/chats/' || conv_id || '.txt' AS path FROM (SELECT DISTINCT conv_id FROM conversations WHERE role IN ('user', 'assistant')) WHERE conv_id % 3 <> 0")
def already_mined_anti(spark: SparkSession, d: str) -> DataFrame:
    files = _chat_files(spark, d).select("path")
    filed = files.where(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long") % 3 == 0).withColumnRenamed("path", "source_file")
    return already_filed(files, filed)


def _export(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Every conversation of two messages or more as a chat export, normalised back to a transcript."""
    rows = views.conv_messages(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("ord", "role", "text"))).alias("ms")).where("size(ms) >= 2")
    json_of = lambda f: F.to_json(F.transform("ms", f))
    line = lambda *fields: F.to_json(F.struct(*fields))
    if kind == "flat":
        body = json_of(lambda m: F.struct(F.when(m["role"] == "user", "human").otherwise("ai").alias("role"), F.array(F.struct(F.lit("text").alias("type"), m["text"].alias("text"))).alias("content")))
    elif kind == "session":
        body = F.array_join(F.transform("ms", lambda m: line(m["role"].alias("type"), F.struct(m["text"].alias("content")).alias("message"))), "\n{broken\n")
    elif kind == "events":
        said = lambda m: line(F.lit("event_msg").alias("type"), F.struct(F.when(m["role"] == "user", "user_message").otherwise("agent_message").alias("type"), m["text"].alias("message")).alias("payload"))
        body = F.concat(F.lit('{"type":"session_meta"}\n'), F.array_join(F.transform("ms", said), "\n"))
    elif kind == "tree":
        node = lambda m, i: F.struct(
            F.concat(F.lit("n"), (i + 1).cast("string")).alias("key"),
            F.struct(
                F.concat(F.lit("n"), i.cast("string")).alias("parent"),
                F.struct(F.struct(m["role"].alias("role")).alias("author"), F.struct(F.array(m["text"]).alias("parts")).alias("content")).alias("message"),
                F.array(F.concat(F.lit("n"), (i + 2).cast("string"))).alias("children"),
            ).alias("value"),
        )
        nodes = F.map_from_entries(F.transform("ms", node))
        body = F.concat(F.lit('{"mapping":{"n0":{"parent":null,"message":null,"children":["n1"]},'), F.substring(F.to_json(nodes), 2, 2_000_000_000), F.lit("}"))
    else:
        body = json_of(lambda m: F.struct(F.lit("message").alias("type"), F.when(m["role"] == "user", "U1").otherwise("U2").alias("user"), m["text"].alias("text")))
    files = rows.select(F.concat(F.col("conv_id").cast("string"), F.lit(".json")).alias("path"), body.alias("content"))
    return T.normalize(files).select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("conv_id"), F.col("content").alias("transcript"))


for _kind in ("flat", "session", "events", "tree"):
    query(sql("conv_messages", f"WITH {_TRANSCRIPTS} SELECT conv_id, content AS transcript FROM transcripts WHERE n_messages >= 2"), f"normalize_{_kind}")(lambda spark, d, k=_kind: _export(spark, d, k))
#: In channels whoever speaks first is the user.
_CHANNEL = "turned AS (SELECT conv_id, ord, CASE WHEN role = first_value(role) OVER (PARTITION BY conv_id ORDER BY ord) THEN 'user' ELSE 'assistant' END AS role, text FROM conv_messages)"
query(sql("conv_messages", f"WITH {_CHANNEL}, {_TRANSCRIPTS.replace('FROM conv_messages', 'FROM turned')} SELECT conv_id, content AS transcript FROM transcripts WHERE n_messages >= 2"), "normalize_channel")(lambda spark, d: _export(spark, d, "channel"))


# ── Summaries ────────────────────────────────────────────────────────────────

_TOPICS = f"""words AS (SELECT note_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM (SELECT note_id, regexp_extract_all(text, '[a-zA-Z][a-zA-Z_-]{{2,}}') AS ws FROM notes)),
    weights AS (SELECT note_id, lower(w) AS u, min(pos) AS pos, sum(1 + CASE WHEN regexp_matches(substring(w, 1, 1), '[A-Z]') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(w, '[_-]') OR regexp_matches(substring(w, 2), '[A-Z]') THEN 2 ELSE 0 END) AS weight
      FROM words WHERE NOT list_contains({_list(X.STOP_WORDS)}, lower(w)) GROUP BY note_id, lower(w)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY weight DESC, pos) AS nth FROM weights),
    topics AS (SELECT note_id, string_agg(u, '_' ORDER BY nth) AS topics FROM ranked WHERE nth <= 3 GROUP BY note_id)"""
_SENTENCES = f"""pieces AS (SELECT note_id, unnest(ss) AS s, unnest(range(1, len(ss) + 1)) AS pos FROM (SELECT note_id, list_transform(regexp_split_to_array(text, '[.!?\\n]+'), lambda p: {_trim('p')}) AS ss FROM notes)),
    scored AS (SELECT *, 2 * {_count_sql('lower(s)', X.DECISION_WORDS)} + CASE WHEN length(s) < 80 THEN 1 ELSE 0 END + CASE WHEN length(s) < 40 THEN 1 ELSE 0 END - CASE WHEN length(s) > 150 THEN 2 ELSE 0 END AS score FROM pieces WHERE length(s) > 10),
    sentences AS (SELECT note_id, CASE WHEN length(s) > 55 THEN substring(s, 1, 52) || '...' ELSE s END AS sentence FROM (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY score DESC, pos) AS nth FROM scored) WHERE nth = 1)"""
_PEOPLE = f"""tokens AS (SELECT note_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM (SELECT note_id, regexp_split_to_array(text, '\\s+') AS ws FROM notes)),
    names AS (SELECT note_id, upper(substring(c, 1, 3)) AS code, min(pos) AS pos FROM (SELECT note_id, pos, regexp_replace(w, '[^a-zA-Z]', '', 'g') AS c FROM tokens WHERE pos > 1)
      WHERE regexp_full_match(c, '[A-Z][a-z]+') AND NOT list_contains({_list(X.STOP_WORDS)}, lower(c)) GROUP BY note_id, upper(substring(c, 1, 3))),
    guessed AS (SELECT note_id, string_agg(code, '+' ORDER BY nth) AS people FROM (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY pos) AS nth FROM names) WHERE nth <= 3 GROUP BY note_id)"""
_EMOTIONS, _FLAGS = _contained_sql("text", X.EMOTION_SIGNALS), _contained_sql("text", X.FLAG_SIGNALS)
_SUMMARY = f"""{_TOPICS}, {_SENTENCES}, {_PEOPLE}, parts AS (SELECT note_id, user_id, text, '0:' || coalesce(people, '???') || '|' || coalesce(topics, 'misc') || coalesce('|"' || sentence || '"', '') || CASE WHEN e <> '' THEN '|' || e ELSE '' END || CASE WHEN f <> '' THEN '|' || f ELSE '' END AS body
      FROM (SELECT *, {_EMOTIONS} AS e, {_FLAGS} AS f FROM notes) LEFT JOIN topics USING (note_id) LEFT JOIN sentences USING (note_id) LEFT JOIN guessed USING (note_id)),
    summaries AS (SELECT *, 'w' || (user_id % 5) || '|notes|?|n' || note_id || chr(10) || body AS summary FROM parts)"""


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    notes = views.spread_notes(spark, d)
    wing = F.concat(F.lit("w"), (F.col("user_id") % 5).cast("string"))
    file = F.concat(F.lit("/notes/n"), F.col("note_id").cast("string"), F.lit(".txt"))
    return once(notes, {"summary": S.compress("text", source_file=file, wing=wing, room=F.lit("notes"))})


@query(sql("notes", f"SELECT note_id, {_EMOTIONS} AS emotions FROM notes"))
def emotions(spark: SparkSession, d: str) -> DataFrame:
    return views.notes(spark, d).select("note_id", F.array_join(S.emotions("text"), "+").alias("emotions"))


@query(sql("notes", f"SELECT note_id, {_FLAGS} AS flags FROM notes"))
def flags(spark: SparkSession, d: str) -> DataFrame:
    return views.notes(spark, d).select("note_id", F.array_join(S.flags("text"), "+").alias("flags"))


@query(sql("notes", f"WITH {_TOPICS} SELECT note_id, coalesce(topics, '') AS topics FROM notes LEFT JOIN topics USING (note_id)"))
def topics(spark: SparkSession, d: str) -> DataFrame:
    return views.spread_notes(spark, d).select("note_id", F.array_join(S.topics("text"), "_").alias("topics"))


@query(sql("notes", f"WITH {_SENTENCES} SELECT note_id, coalesce(sentence, '') AS sentence FROM notes LEFT JOIN sentences USING (note_id)"))
def key_sentence(spark: SparkSession, d: str) -> DataFrame:
    return views.spread_notes(spark, d).select("note_id", S.key_sentence("text").alias("sentence"))


@query(sql("notes", f"WITH {_PEOPLE} SELECT note_id, coalesce(people, '') AS people FROM notes LEFT JOIN guessed USING (note_id)"))
def entities_in_text(spark: SparkSession, d: str) -> DataFrame:
    return views.spread_notes(spark, d).select("note_id", F.array_join(S.entities("text"), "+").alias("people"))


@query(sql("notes", f"WITH {_PEOPLE} SELECT note_id, CASE WHEN contains(lower(text), 'grace') THEN 'GRC' || CASE WHEN contains(lower(text), 'quartz') THEN '+QTZ' ELSE '' END WHEN contains(lower(text), 'quartz') THEN 'QTZ' ELSE coalesce(people, '') END AS people FROM notes LEFT JOIN guessed USING (note_id)"))
def known_entities_in_text(spark: SparkSession, d: str) -> DataFrame:
    return views.spread_notes(spark, d).select("note_id", F.array_join(S.entities("text", {"Grace": "GRC", "Quartz": "QTZ", "bob": "BOB"}), "+").alias("people"))


@query(sql("notes", f"WITH {_SUMMARY} SELECT note_id, summary FROM summaries"))
def compress(spark: SparkSession, d: str) -> DataFrame:
    return _summaries(spark, d).select("note_id", "summary")


@query(sql("document_notes", f"WITH {_TOPICS} SELECT note_id, coalesce(topics, '') AS topics FROM notes LEFT JOIN topics USING (note_id)"))
def topics_of_documents(spark: SparkSession, d: str) -> DataFrame:
    return views.document_notes(spark, d).select("note_id", F.array_join(S.topics("text"), "_").alias("topics"))


@query(sql("document_notes", f"WITH {_SUMMARY} SELECT note_id, body FROM parts"))
def compress_documents(spark: SparkSession, d: str) -> DataFrame:
    return views.document_notes(spark, d).select("note_id", S.compress("text").alias("body"))


_TOKENS = lambda x: f"CAST(greatest(1, floor(len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')) * 1.3 + 0.5)) AS BIGINT)"


@query(sql("notes", f"WITH {_SUMMARY} SELECT note_id, o AS original_tokens_est, s AS summary_tokens_est, floor(CAST(o AS DOUBLE) / s * 10 + 0.5) / 10 AS size_ratio, length(text) AS original_chars, length(summary) AS summary_chars FROM (SELECT *, {_TOKENS('text')} AS o, {_TOKENS('summary')} AS s FROM summaries)"))
def compress_stats(spark: SparkSession, d: str) -> DataFrame:
    return once(_summaries(spark, d), {"s": S.compression_stats("text", "summary")}).select("note_id", "s.*")


@query(f"SELECT doc_id, {_TOKENS('text')} AS tokens FROM documents")
def count_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.count_tokens("text").alias("tokens"))


@query(sql("notes", f"WITH {_SUMMARY} SELECT note_id, 'w' || (user_id % 5) AS file, 'notes' AS entities, '?' AS date, 'n' || note_id AS title, 'calm' AS arc, body AS zettels, 'T:1<->2|x' AS tunnels FROM summaries"))
def decode(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws("\n", "summary", F.lit("ARC:calm"), F.lit("T:1<->2|x"))
    found = once(_summaries(spark, d), {"x": S.decode(text)}).select("note_id", "x.*")
    return found.withColumns({"zettels": F.array_join("zettels", ";"), "tunnels": F.array_join("tunnels", ";")})


@query(
    sql(
        "notes",
        """SELECT note_id, CAST(note_id AS VARCHAR) || ':' || CASE WHEN user_id % 6 = 3 THEN 'GRC' ELSE upper(substring(["Alice", "Bob", "Riley", "Grace", "Jordan", "Maxwell"][user_id % 6 + 1], 1, 3)) END || '|tea_cake|"' || 'We never forget what matters here' || '"|' || CASE WHEN user_id % 2 = 0 THEN '1' ELSE '0.5' END || '|joy+blue|CORE+PIVOT' AS line FROM notes""".replace('"Alice", "Bob", "Riley", "Grace", "Jordan", "Maxwell"', ", ".join(map(_q, views.NAMES))),
    )
)
def encode_zettel(spark: SparkSession, d: str) -> DataFrame:
    notes = views.spread_notes(spark, d)
    name = F.element_at(F.array(*map(F.lit, views.NAMES)), (F.col("user_id") % 6).cast("int") + 1)
    z = F.struct(
        F.concat(F.lit("zettel-"), F.col("note_id").cast("string")).alias("id"),
        F.array(name, F.lit("the skipped one")).alias("people"),
        F.array(F.lit("tea"), F.lit("cake"), F.lit("jam")).alias("topics"),
        F.lit('She said "we met at noon" and then: "We never forget what matters here".').alias("content"),
        F.lit("").alias("origin_label"),
        F.lit("a pivot at the core").alias("notes"),
        F.lit("A title - of note").alias("title"),
        F.when(F.col("user_id") % 2 == 0, 1.0).alias("emotional_weight"),
        F.array(F.lit("joy"), F.lit("joyful"), F.lit("bluest")).alias("emotional_tone"),
        F.lit(False).alias("origin_moment"),
        F.lit("low").alias("sensitivity"),
    )
    return notes.select("note_id", z.alias("z")).select("note_id", S.encode_zettel(F.col("z"), {"Grace": "GRC"}, ["skipped"]).alias("line"))


# ── Entities ─────────────────────────────────────────────────────────────────

_STOP = _list([*dict.fromkeys([*X.STOP_WORDS, *X.NO_NAMES])])
_COMBINED = "whole AS (SELECT user_id, string_agg(text, chr(10) ORDER BY note_id) AS text FROM notes GROUP BY user_id)"
_FIRST_TEN = "firsts AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY note_id) AS nth FROM notes), whole AS (SELECT user_id, string_agg(substring(text, 1, 5000), chr(10) ORDER BY nth) AS text FROM firsts WHERE nth <= 10 GROUP BY user_id)"
_CANDIDATES = f"""found AS (SELECT user_id, unnest(list_concat(regexp_extract_all(text, '\\b[A-Z][a-z]{{1,19}}\\b'), regexp_extract_all(text, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+\\b'))) AS name FROM whole),
    cands AS (SELECT user_id, name, count(*) AS frequency FROM found WHERE len(list_filter(regexp_split_to_array(lower(name), '\\s+'), lambda w: list_contains({_STOP}, w))) = 0 GROUP BY user_id, name HAVING count(*) >= 3)"""


def _hits(pattern: str, options: str = "i") -> str:
    before, *rest = pattern.split("{}")
    joined = _q(f"(?{options})" + before) + "".join(f" || name || {_q(r)}" for r in rest)
    return f"len(regexp_extract_all(text, {joined}))"


_PRONOUN = f"(SELECT count(*) FROM ls a WHERE a.user_id = c.user_id AND contains(a.line, lower(c.name)) AND EXISTS (SELECT 1 FROM ls b WHERE b.user_id = a.user_id AND b.pos BETWEEN a.pos - 2 AND a.pos + 2 AND regexp_matches(b.line, '\\b(?:{'|'.join(X.PRONOUNS)})\\b')))"
_PERSON = [(3, _hits(p, "im"), "'dialogue marker'") for p in X.DIALOGUE_PATTERNS] + [(2, _hits(p), "'''' || name || ' ...'' action'") for p in X.PERSON_VERBS] + [(2, _PRONOUN, "'pronoun nearby'"), (4, _hits(X.DIRECT_PATTERN), "'addressed directly'")]
_PROJECT = [(2, _hits(p), "'project verb'") for p in X.PROJECT_VERBS] + [(3, _hits(X.VERSIONED_PATTERN), "'versioned/hyphenated'"), (3, _hits(X.CODE_PATTERN), "'code file reference'")]


def _side(rows: list[tuple[int, str, str]], name: str) -> str:
    score = " + ".join(f"{w} * {name}{i}" for i, (w, _, _) in enumerate(rows))
    signals = ", ".join(f"CASE WHEN {name}{i} > 0 THEN {label} || ' (' || {name}{i} || 'x)' END" for i, (_, _, label) in enumerate(rows))
    return f"{score} AS {name}_score, list_filter([{signals}], lambda x: x IS NOT NULL)[1:3] AS {name}_signals"


_SCORED = f"""ls AS (SELECT user_id, unnest(string_split(lower(text), chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM whole),
    counted AS (SELECT user_id, name, frequency, {', '.join(f'{x} AS person{i}' for i, (_, x, _) in enumerate(_PERSON))}, {', '.join(f'{x} AS project{i}' for i, (_, x, _) in enumerate(_PROJECT))} FROM cands c JOIN whole USING (user_id)),
    scored AS (SELECT user_id, name, frequency, {_side(_PERSON, 'person')}, {_side(_PROJECT, 'project')} FROM counted)"""
_KINDS = " + ".join(f"CAST(len(list_filter(person_signals, lambda s: contains(s, '{w}'))) > 0 AS INTEGER)" for w in ("dialogue", "action", "pronoun", "addressed"))
_CLASSIFIED = f"""judged AS (SELECT *, CAST(person_score AS DOUBLE) / nullif(person_score + project_score, 0) AS ratio, {_KINDS} AS kinds FROM scored),
    classified AS (SELECT *, CASE WHEN ratio IS NULL THEN 'uncertain' WHEN ratio >= 0.7 AND kinds >= 2 AND person_score >= 5 THEN 'person' WHEN ratio >= 0.7 THEN 'uncertain' WHEN ratio <= 0.3 THEN 'project' ELSE 'uncertain' END AS type,
      floor(CASE WHEN ratio IS NULL THEN least(0.4::DOUBLE, CAST(frequency AS DOUBLE) / 50) WHEN ratio >= 0.7 AND kinds >= 2 AND person_score >= 5 THEN least(0.99::DOUBLE, 0.5 + ratio * 0.5) WHEN ratio >= 0.7 THEN 0.4::DOUBLE WHEN ratio <= 0.3 THEN least(0.99::DOUBLE, 0.5 + (1 - ratio) * 0.5) ELSE 0.5::DOUBLE END * 100 + 0.5) / 100 AS confidence FROM judged)"""
_DETECT = f"{_COMBINED}, {_CANDIDATES}, {_SCORED}, {_CLASSIFIED}"


def _whole(spark: SparkSession, d: str) -> DataFrame:
    return E.combined(views.notes(spark, d), "user_id", "note_id")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    whole = _whole(spark, d)
    return E.score(E.candidates(whole, "user_id"), whole, "user_id")


@query(sql("notes", f"WITH {_COMBINED}, {_CANDIDATES} SELECT * FROM cands"))
def candidates(spark: SparkSession, d: str) -> DataFrame:
    return E.candidates(_whole(spark, d), "user_id")


@query(sql("document_notes", f"WITH {_COMBINED}, {_CANDIDATES} SELECT * FROM cands"))
def candidates_of_documents(spark: SparkSession, d: str) -> DataFrame:
    return E.candidates(views.document_notes(spark, d), "user_id")


@query(sql("notes", f"WITH {_COMBINED}, {_CANDIDATES}, {_SCORED} SELECT user_id, name, frequency, CAST(person_score AS INTEGER) AS person_score, CAST(project_score AS INTEGER) AS project_score, array_to_string(person_signals, '; ') AS person_signals, array_to_string(project_signals, '; ') AS project_signals FROM scored"))
def score_entities(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).withColumns({c: F.array_join(c, "; ") for c in ("person_signals", "project_signals")})


@query(sql("notes", f"WITH {_DETECT} SELECT user_id, name, type, confidence FROM classified"))
def classify_entities(spark: SparkSession, d: str) -> DataFrame:
    return E.classify(_scores(spark, d)).select("user_id", "name", "type", "confidence")


@query(
    sql(
        "notes",
        f"""WITH {_DETECT.replace(_COMBINED, _FIRST_TEN)} SELECT user_id, name, type, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, type ORDER BY CASE WHEN type = 'uncertain' THEN frequency ELSE confidence END DESC, frequency DESC, name) AS rank FROM classified)
        WHERE rank <= CASE type WHEN 'person' THEN 15 WHEN 'project' THEN 10 ELSE 8 END""",
    )
)
def detect_entities(spark: SparkSession, d: str) -> DataFrame:
    return E.detect(views.notes(spark, d), "user_id", "note_id").select("user_id", "name", "type", F.col("rank").cast("long").alias("rank"))


# ── Registry ─────────────────────────────────────────────────────────────────

_SEEDED = "people AS (SELECT * FROM (VALUES ('Alice', 'Ally', 0), ('Grace', NULL, 1), ('Riley', NULL, 2), ('Bob', 'Robert', 3)) t(name, alias, ord))"
_FLAGGED = "('grace')"


def _people(spark: SparkSession) -> DataFrame:
    named = spark.createDataFrame([(" Alice ", "friend", None, 0), ("Grace", "sister", "family", 1), ("Riley", None, None, 2), ("Bob", "boss", "work", 3), ("  ", None, None, 4)], "name string, relationship string, context string, ord int")
    aliases = spark.createDataFrame([("Al", "Alice", 0), ("Ally", "Alice", 1), ("Robert", "Bob", 2)], "alias string, canonical string, ord int")
    return R.seed(named, aliases)


def _projects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("Atlas", 0), ("Nimbus", 1)], "name string, ord int")


def _wiki(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("Quartz", "concept", 0.6, True), ("Jordan", "place", 0.8, False)], "word string, inferred_type string, confidence double, confirmed boolean")


@query(f"WITH {_SEEDED} SELECT name, coalesce(alias, '') AS aliases, '' AS canonical FROM people UNION ALL SELECT alias, name, name FROM people WHERE alias IS NOT NULL")
def registry_seed(spark: SparkSession, d: str) -> DataFrame:
    return _people(spark).select("name", F.array_join("aliases", ",").alias("aliases"), F.coalesce("canonical", F.lit("")).alias("canonical"))


def _matches(patterns: Sequence[str]) -> str:
    each = []
    for p in patterns:
        before, *rest = p.split("{}")
        each.append(f"CAST(regexp_matches(lower(context), {_q(before)}" + "".join(f" || lower(word) || {_q(r)}" for r in rest) + ") AS INTEGER)")
    return "(" + " + ".join(each) + ")"


_WORDS = f"words AS (SELECT note_id AS word_id, {views._LIST(views.NAMES)}[user_id % 6 + 1] AS word, text AS context FROM notes UNION ALL SELECT -1 - note_id, {views._LIST(views.PROJECTS)}[user_id % 3 + 1], text FROM notes)"
_JUDGED = f"judged AS (SELECT *, {_matches(X.PERSON_CONTEXTS)} AS p, {_matches(X.CONCEPT_CONTEXTS)} AS c FROM words)"


def _lookup_words(spark: SparkSession, d: str) -> DataFrame:
    notes = views.spread_notes(spark, d)
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (F.col("user_id") % n).cast("int") + 1)
    own = notes.select(F.col("note_id").alias("word_id"), pick(views.NAMES, 6).alias("word"), F.col("text").alias("context"))
    return own.unionAll(notes.select((-1 - F.col("note_id")), pick(views.PROJECTS, 3), "text"))


@query(sql("notes", f"WITH {_WORDS}, {_JUDGED} SELECT word_id, p AS person_score, c AS concept_score, CASE WHEN p > c THEN 'person' WHEN c > p THEN 'concept' END AS meaning, CASE WHEN p > c THEN least(0.95::DOUBLE, 0.7::DOUBLE + p * 0.1::DOUBLE) WHEN c > p THEN least(0.9::DOUBLE, 0.7::DOUBLE + c * 0.1::DOUBLE) END AS sure FROM judged"))
def disambiguate(spark: SparkSession, d: str) -> DataFrame:
    return R.disambiguate(_lookup_words(spark, d)).select("word_id", "person_score", "concept_score", "meaning", "sure")


@query(
    sql(
        "notes",
        f"""WITH {_WORDS}, {_JUDGED}, k AS (SELECT *, word IN ('Alice', 'Grace', 'Riley', 'Bob') AS person, word = 'Grace' AND p <> c AS decided FROM judged)
        SELECT word_id, word, CASE WHEN decided AND c > p THEN 'concept' WHEN person THEN 'person' WHEN word IN ('Atlas', 'Nimbus') THEN 'project' WHEN word = 'Quartz' THEN 'concept' ELSE 'unknown' END AS type,
        CASE WHEN decided AND c > p THEN least(0.9::DOUBLE, 0.7::DOUBLE + c * 0.1::DOUBLE) WHEN decided THEN least(0.95::DOUBLE, 0.7::DOUBLE + p * 0.1::DOUBLE) WHEN person OR word IN ('Atlas', 'Nimbus') THEN 1::DOUBLE WHEN word = 'Quartz' THEN 0.6::DOUBLE ELSE 0::DOUBLE END AS confidence,
        CASE WHEN decided AND c > p THEN 'context_disambiguated' WHEN person OR word IN ('Atlas', 'Nimbus') THEN 'onboarding' WHEN word = 'Quartz' THEN 'wiki' ELSE 'none' END AS source, word AS name, decided AS disambiguated FROM k""",
    )
)
def registry_lookup(spark: SparkSession, d: str) -> DataFrame:
    return R.lookup(_lookup_words(spark, d), _people(spark), _projects(spark), _wiki(spark))


@query(sql("notes", f"SELECT note_id AS query_id, w AS word FROM (SELECT note_id, unnest(list_distinct(regexp_extract_all(text, '\\b[A-Z][a-z]{{2,15}}\\b'))) AS w FROM notes) WHERE NOT list_contains({_list(X.COMMON_WORDS)}, lower(w)) AND w NOT IN ('Alice', 'Grace', 'Riley', 'Bob', 'Atlas', 'Nimbus', 'Quartz')"))
def unknown_candidates(spark: SparkSession, d: str) -> DataFrame:
    queries = views.spread_notes(spark, d).select(F.col("note_id").alias("query_id"), "text")
    return R.unknown_words(queries, _people(spark), _projects(spark), _wiki(spark))


@query(
    sql(
        "notes",
        f"""WITH {_WORDS.replace('UNION ALL', 'WHERE true UNION ALL')}, {_JUDGED}, alias AS (SELECT * FROM (VALUES ('Alice', 'Alice'), ('Alice', 'Ally'), ('Bob', 'Bob'), ('Bob', 'Robert'), ('Riley', 'Riley'), ('Grace', 'Grace')) t(word, name)) SELECT word_id AS query_id, name FROM judged JOIN alias USING (word) WHERE word_id >= 0 AND word IN ('Alice', 'Riley', 'Bob', 'Grace') AND regexp_matches(context, '(?i)\\b' || word || '\\b') AND (word <> 'Grace' OR p > c)""",
    )
)
def people_in_query(spark: SparkSession, d: str) -> DataFrame:
    queries = views.spread_notes(spark, d).select(F.col("note_id").alias("query_id"), "text")
    return R.people_in(queries, _people(spark))


_PAGE_RULES = [
    (404, "", "", "", "person", 0.7),
    (500, "", "", "", "unknown", 0.0),
    (200, "disambiguation", "Given name", "", "person", 0.65),
    (200, "disambiguation", "Topics", "", "ambiguous", 0.4),
    (200, "standard", "", "{w} is a Given Name", "person", 0.9),
    (200, "standard", "", "An Irish name", "person", 0.8),
    (200, "standard", "", "A city in the north", "place", 0.8),
    (200, "standard", "", "A theory", "concept", 0.6),
]


@query(
    f"""WITH r AS (SELECT * FROM (VALUES {', '.join(f"({i}, {_q(r[4])}, {r[5]}::DOUBLE, {_q(r[3].lower())}, {r[0]})" for i, r in enumerate(_PAGE_RULES))}) t(k, kind, sure, extract, status))
    SELECT p_name || p_partkey AS word, kind AS inferred_type, sure AS confidence, CASE WHEN status = 200 THEN substring(replace(extract, '{{w}}', lower(p_name || p_partkey)), 1, 200) END AS summary FROM part JOIN r ON r.k = p_partkey % 8"""
)
def research_classify(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    at = (F.col("p_partkey") % 8).cast("int") + 1
    pick = lambda i: F.element_at(F.array(*(F.lit(r[i]) for r in _PAGE_RULES)), at)
    word = F.concat("p_name", F.col("p_partkey").cast("string"))
    pages = part.select(word.alias("word"), pick(0).alias("status"), pick(1).alias("page_type"), F.lit(None).cast("string").alias("title"), pick(2).alias("description"), F.replace(pick(3), F.lit("{w}"), word).alias("extract"))
    return R.classify_pages(pages).select("word", "inferred_type", "confidence", "summary")


_PARTS = "whole AS (SELECT user_id * 4 + note_id % 4 AS user_id, string_agg(text, chr(10) ORDER BY note_id) AS text FROM notes GROUP BY 1)"


@query(sql("notes", f"WITH {_DETECT.replace(_COMBINED, _PARTS)} SELECT name, max(confidence) AS confidence, max(frequency) AS seen_count FROM classified WHERE type = 'person' AND confidence >= 0.75 AND name NOT IN ('Alice', 'Ally', 'Grace', 'Riley', 'Bob', 'Robert', 'Atlas', 'Nimbus') GROUP BY name"))
def registry_learn(spark: SparkSession, d: str) -> DataFrame:
    """Each user's notes as four texts, in some of which people are addressed."""
    notes = views.notes(spark, d).withColumn("user_id", F.col("user_id") * 4 + F.col("note_id") % 4)
    whole = E.combined(notes, "user_id", "note_id")
    found = E.classify(E.score(E.candidates(whole, "user_id"), whole, "user_id"))
    return R.learn(found, _people(spark), _projects(spark)).select("name", "confidence", "seen_count")


@query("SELECT 'Mode: personal' || chr(10) || 'People: 6 (Alice, Ally, Grace, Riley, Bob, Robert)' || chr(10) || 'Projects: Atlas, Nimbus' || chr(10) || 'Ambiguous flags: grace' || chr(10) || 'Wiki cache: 2 entries' AS summary")
def registry_summary(spark: SparkSession, d: str) -> DataFrame:
    return R.summary(_people(spark), _projects(spark), _wiki(spark))


# ── Layers ───────────────────────────────────────────────────────────────────

_TOP = "top AS (SELECT ord, room, content, coalesce(CAST(quality AS DOUBLE), 3) AS importance FROM drawers WHERE content <> '' ORDER BY importance DESC, ord LIMIT 15)"
_STORY = f"""{_TOP}, entries AS (SELECT room || ',' AS k, row_number() OVER (PARTITION BY room ORDER BY importance DESC, ord) AS i, '  - ' || CASE WHEN length(s) > 200 THEN substring(s, 1, 197) || '...' ELSE s END || '  (doc' || ord || '.txt)' AS line
      FROM (SELECT *, replace({_trim('content')}, chr(10), ' ') AS s FROM top)), heads AS (SELECT DISTINCT room || ',' AS k, 0 AS i, chr(10) || '[' || room || ']' AS line FROM top),
    used AS (SELECT *, sum(length(line)) OVER (ORDER BY k, i) AS total FROM (SELECT * FROM entries UNION ALL SELECT * FROM heads)), stop AS (SELECT min(row(k, i)) AS edge FROM used WHERE i > 0 AND total > 3200),
    story AS (SELECT row_number() OVER (ORDER BY k, i) AS nth, CASE WHEN row(k, i) = edge THEN '  ... (more in L3 search)' ELSE line END AS line FROM used, stop WHERE edge IS NULL OR row(k, i) <= edge)"""


@query(sql("drawers", f"WITH {_TOP} SELECT * FROM top"))
def essential_story_topn(spark: SparkSession, d: str) -> DataFrame:
    return L.most_important(views.drawers(spark, d)).select("ord", "room", "content", "importance")


@query(sql("drawers", f"WITH {_STORY} SELECT nth, line FROM story"))
def essential_story_budget(spark: SparkSession, d: str) -> DataFrame:
    return L.story_lines(views.drawers(spark, d))


_IDENTITY = f"{L.IDENTITY_TITLE}\nI keep notes."


@query(sql("drawers", f"WITH {_STORY}, t AS (SELECT {_q(L.IDENTITY_TITLE)} || chr(10) || 'I keep notes.' || chr(10) || chr(10) || {_q(L.STORY_TITLE)} || chr(10) || string_agg(line, chr(10) ORDER BY nth) AS text FROM story) SELECT text, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM t"))
def wake_up(spark: SparkSession, d: str) -> DataFrame:
    return L.wake_up(views.drawers(spark, d), _IDENTITY)


@query(sql("drawers", f"SELECT count(*) AS total_drawers, CAST(ceil({len(_IDENTITY)} / 4.0) AS BIGINT) AS identity_tokens FROM drawers"))
def layer_status(spark: SparkSession, d: str) -> DataFrame:
    return L.layer_status(views.drawers(spark, d), _IDENTITY)


@query(
    sql(
        "vectors",
        """WITH s AS (SELECT q.id AS query_id, v.id, v.wing, v.room, floor(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) * 1000 + 0.5) / 1000 AS sim FROM vectors q, vectors v WHERE q.id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s)
        SELECT query_id, rank, '  [' || rank || '] ' || wing || '/' || room || ' (sim=' || sim || ')' || chr(10) || '      item ' || id || chr(10) || '      src: v' || id || '.txt' AS text FROM r WHERE rank <= 5""",
    )
)
def deep_search(spark: SparkSession, d: str) -> DataFrame:
    from memloom.operators.vectors import nearest

    vectors = views.vectors(spark, d)
    hits = nearest(vectors, vectors.where("id % 20 = 0").select("id", "embedding"), 5)
    number: Column = F.col("id").cast("string")
    full = hits.join(vectors.select("id", "wing", "room").hint("merge"), "id").withColumns({"content": F.concat(F.lit("item "), number), "source_file": F.concat(F.lit("/v/v"), number, F.lit(".txt"))})
    return L.deep_search_lines(full).withColumn("rank", F.col("rank").cast("long"))


# ── Checkpoints ──────────────────────────────────────────────────────────────


@query("SELECT conv_id, turn, messages FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS messages FROM conversations WHERE role = 'user' AND NOT contains(text, '<command-message>')) WHERE messages % 3 = 0")
def conversation_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """A save at each third message that counts."""
    said = table(spark, d, "conversations").where(counts_as_message(F.col("role"), F.col("text")))
    return checkpoints(said, "conv_id", "turn", interval=3).select("conv_id", "turn", "messages")


@query("SELECT user_id, event_id, messages FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS messages FROM events) WHERE messages % 15 = 0")
def hook_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return checkpoints(events, "user_id", "at").select("user_id", "event_id", "messages")
