"""Keyword tables whose contents and order decide results."""

from __future__ import annotations

#: Emotion names to codes.
EMOTION_CODES = {
    "vulnerability": "vul",
    "vulnerable": "vul",
    "joy": "joy",
    "joyful": "joy",
    "fear": "fear",
    "mild_fear": "fear",
    "trust": "trust",
    "trust_building": "trust",
    "grief": "grief",
    "raw_grief": "grief",
    "wonder": "wonder",
    "philosophical_wonder": "wonder",
    "rage": "rage",
    "anger": "rage",
    "love": "love",
    "devotion": "love",
    "hope": "hope",
    "despair": "despair",
    "hopelessness": "despair",
    "peace": "peace",
    "relief": "relief",
    "humor": "humor",
    "dark_humor": "humor",
    "tenderness": "tender",
    "raw_honesty": "raw",
    "brutal_honesty": "raw",
    "self_doubt": "doubt",
    "anxiety": "anx",
    "exhaustion": "exhaust",
    "conviction": "convict",
    "quiet_passion": "passion",
    "warmth": "warmth",
    "curiosity": "curious",
    "gratitude": "grat",
    "frustration": "frust",
    "confusion": "confuse",
    "satisfaction": "satis",
    "excitement": "excite",
    "determination": "determ",
    "surprise": "surprise",
}
#: Words in a text that signal an emotion.
EMOTION_SIGNALS = [
    ("decided", "determ"),
    ("prefer", "convict"),
    ("worried", "anx"),
    ("excited", "excite"),
    ("frustrated", "frust"),
    ("confused", "confuse"),
    ("love", "love"),
    ("hate", "rage"),
    ("hope", "hope"),
    ("fear", "fear"),
    ("trust", "trust"),
    ("happy", "joy"),
    ("sad", "grief"),
    ("surprised", "surprise"),
    ("grateful", "grat"),
    ("curious", "curious"),
    ("wonder", "wonder"),
    ("anxious", "anx"),
    ("relieved", "relief"),
    ("satisf", "satis"),
    ("disappoint", "grief"),
    ("concern", "anx"),
]
#: Words in a text that raise a flag.
FLAG_SIGNALS = [
    ("decided", "DECISION"),
    ("chose", "DECISION"),
    ("switched", "DECISION"),
    ("migrated", "DECISION"),
    ("replaced", "DECISION"),
    ("instead of", "DECISION"),
    ("because", "DECISION"),
    ("founded", "ORIGIN"),
    ("created", "ORIGIN"),
    ("started", "ORIGIN"),
    ("born", "ORIGIN"),
    ("launched", "ORIGIN"),
    ("first time", "ORIGIN"),
    ("core", "CORE"),
    ("fundamental", "CORE"),
    ("essential", "CORE"),
    ("principle", "CORE"),
    ("belief", "CORE"),
    ("always", "CORE"),
    ("never forget", "CORE"),
    ("turning point", "PIVOT"),
    ("changed everything", "PIVOT"),
    ("realized", "PIVOT"),
    ("breakthrough", "PIVOT"),
    ("epiphany", "PIVOT"),
    ("api", "TECHNICAL"),
    ("database", "TECHNICAL"),
    ("architecture", "TECHNICAL"),
    ("deploy", "TECHNICAL"),
    ("infrastructure", "TECHNICAL"),
    ("algorithm", "TECHNICAL"),
    ("framework", "TECHNICAL"),
    ("server", "TECHNICAL"),
    ("config", "TECHNICAL"),
]
#: Words that are no topic.
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can to of in for on with at by "
    "from as into about between through during before after above below up down out off over under again further then once here there when "
    "where why how all each every both few more most other some such no nor not only own same so than too very just don now and but or if "
    "while that this these those it its i we you he she they me him her us them my your his our their what which who whom also much many like "
    "because since get got use used using make made thing things way well really want need"
).split()
#: Words of a sentence that report a decision.
DECISION_WORDS = "decided because instead prefer switched chose realized important key critical discovered learned conclusion solution reason why breakthrough insight".split()
#: Words that make a quotation telling.
EMOTIONAL_WORDS = "love fear remember soul feel stupid scared beautiful destroy respect trust consciousness alive forget waiting peace matter real guilt escape rest hope dream lost found".split()
#: Keywords of rooms, in tie-break order.
ROOM_KEYWORDS = {
    "technical": "code python function bug error api database server deploy git test debug refactor".split(),
    "architecture": "architecture design pattern structure schema interface module component service layer".split(),
    "planning": "plan roadmap milestone deadline priority sprint backlog scope requirement spec".split(),
    "decisions": "decided chose picked switched migrated replaced trade-off alternative option approach".split(),
    "problems": "problem issue broken failed crash stuck workaround fix solved resolved".split(),
}
#: Capitalised words that are no name, beside STOP_WORDS: what operators use if they are handed no list of their own.
NO_NAMES = (
    "must yes ok okay still even take put come go see know think true false none null new old any return print def class import step usage run "
    "check find add set list path file type name note example option result error warning info less next last first second mode test stop start "
    "source target output input data item key value world topic people something nothing everything anything someone everyone anyone time day "
    "life place part kind case point idea fact question answer reason number version system hey hi hello thanks thank right let open close save "
    "load launch install search show home library settings terminal tools others memory language technology society future history science model network training"
).split()
#: Common words that are also given names.
COMMON_WORDS = (
    "ever grace will bill mark april may june joy hope faith chance chase hunter dash flash star sky river brook lane art clay gil nat max rex ray "
    "jay rose violet lily ivy ash reed sage monday tuesday wednesday thursday friday saturday sunday january february march july august september "
    "october november december"
).split()

#: Patterns around a name, {} standing for it, in scoring order. A word boundary is ASCII's.
DIALOGUE_PATTERNS = [r"^>\s*{}[:\s]", r"^{}:\s", r"^\[{}\]", r'"{}\s+said']
PERSON_VERBS = [
    r"\b{}\s+said\b",
    r"\b{}\s+asked\b",
    r"\b{}\s+told\b",
    r"\b{}\s+replied\b",
    r"\b{}\s+laughed\b",
    r"\b{}\s+smiled\b",
    r"\b{}\s+cried\b",
    r"\b{}\s+felt\b",
    r"\b{}\s+thinks?\b",
    r"\b{}\s+wants?\b",
    r"\b{}\s+loves?\b",
    r"\b{}\s+hates?\b",
    r"\b{}\s+knows?\b",
    r"\b{}\s+decided\b",
    r"\b{}\s+pushed\b",
    r"\b{}\s+wrote\b",
    r"\bhey\s+{}\b",
    r"\bthanks?\s+{}\b",
    r"\bhi\s+{}\b",
    r"\bdear\s+{}\b",
]
DIRECT_PATTERN = r"\bhey\s+{}\b|\bthanks?\s+{}\b|\bhi\s+{}\b"
PROJECT_VERBS = [
    r"\bbuilding\s+{}\b",
    r"\bbuilt\s+{}\b",
    r"\bship(?:ping|ped)?\s+{}\b",
    r"\blaunch(?:ing|ed)?\s+{}\b",
    r"\bdeploy(?:ing|ed)?\s+{}\b",
    r"\binstall(?:ing|ed)?\s+{}\b",
    r"\bthe\s+{}\s+architecture\b",
    r"\bthe\s+{}\s+pipeline\b",
    r"\bthe\s+{}\s+system\b",
    r"\bthe\s+{}\s+repo\b",
    r"\b{}\s+v\d+\b",
    r"\b{}\.py\b",
    r"\b{}-core\b",
    r"\b{}-local\b",
    r"\bimport\s+{}\b",
    r"\bpip\s+install\s+{}\b",
]
VERSIONED_PATTERN = r"\b{}[-v]\w+"
CODE_PATTERN = r"\b{}\.(py|js|ts|yaml|yml|json|sh)\b"
PRONOUNS = "she her hers he him his they them their".split()

PERSON_CONTEXTS = [
    r"\b{}\s+said\b",
    r"\b{}\s+told\b",
    r"\b{}\s+asked\b",
    r"\b{}\s+laughed\b",
    r"\b{}\s+smiled\b",
    r"\b{}\s+was\b",
    r"\b{}\s+is\b",
    r"\b{}\s+called\b",
    r"\b{}\s+texted\b",
    r"\bwith\s+{}\b",
    r"\bsaw\s+{}\b",
    r"\bcalled\s+{}\b",
    r"\btook\s+{}\b",
    r"\bpicked\s+up\s+{}\b",
    r"\bdrop(?:ped)?\s+(?:off\s+)?{}\b",
    r"\b{}(?:'s|s')\b",
    r"\bhey\s+{}\b",
    r"\bthanks?\s+{}\b",
    r"^{}[:\s]",
    r"\bmy\s+(?:son|daughter|kid|child|brother|sister|friend|partner|colleague|coworker)\s+{}\b",
]
CONCEPT_CONTEXTS = [
    r"\bhave\s+you\s+{}\b",
    r"\bif\s+you\s+{}\b",
    r"\b{}\s+since\b",
    r"\b{}\s+again\b",
    r"\bnot\s+{}\b",
    r"\b{}\s+more\b",
    r"\bwould\s+{}\b",
    r"\bcould\s+{}\b",
    r"\bwill\s+{}\b",
    r"(?:the\s+)?{}\s+(?:of|in|at|for|to)\b",
]
NAME_PHRASES = (
    "given name, personal name, first name, forename, masculine name, feminine name, boy's name, girl's name, male name, female name, irish name, "
    "welsh name, scottish name, gaelic name, hebrew name, arabic name, norse name, old english name, is a name, as a name, name meaning, "
    "name derived from, legendary irish, legendary welsh, legendary scottish"
).split(", ")
PLACE_PHRASES = "city in, town in, village in, municipality, capital of, district of, county, province, region of, island of, mountain in, river in".split(", ")
#: Folders that scans leave out, and the files they take.
SKIPPED_FOLDERS = ".git node_modules __pycache__ .venv venv env dist build .next coverage".split()
CHAT_FILES = ".txt .md .json .jsonl".split()
PROSE_FILES = ".txt .md .rst .csv".split()
OTHER_READABLE_FILES = ".py .js .ts .json .yaml .yml .toml .sh .rb .go .rs".split()
