"""Secret scan by assignment-aware lexing.

Three fixed patterns (the base kinds ``assign``, ``access``, ``hex``) are
matched leftmost and non-overlapping over the whole text.  On top, source and
configuration syntax is lexed into name-literal pairs:

* a name is an identifier, a dotted or subscripted path, a quoted key or a
  command-line flag, followed by ``=``, ``:=``, ``:``, ``=>`` or a typed
  declaration (``name: str = ...``);
* a literal is a quoted string, adjacent quoted strings joined by ``+``, or a
  bare token that ends the line;
* a pair whose right side is another name carries that name's constant on:
  constants are propagated through any chain of names, wherever the constant
  stands in the text;
* each literal is scored by how sensitive the names are that it reaches, and by
  what the literal itself looks like; literals that reach the threshold are
  reported as kind ``literal``.

Defined results: null and empty texts have no spans; a null id is passed
through; repeated rows give one result each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwatch.llm.common import slices

# Fixed patterns of the task.
ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A maximal run of 24 or more: the same spans as the bare run with short matches dropped.
HEX = re.compile(r"[0-9a-f]{24,}")
#: The order of the kinds at one start.
KINDS = ("assign", "access", "hex", "literal")

#: One name-literal or name-name pair.
PAIR = re.compile(
    r"""(?<![\w$.-])(?P<name>["']?-{0,2}[A-Za-z_$][\w$]*(?:(?:\.|->|::)[A-Za-z_]\w*|\[["'][\w-]+["']\]|-(?=\w)\w*)*["']?)
        [ \t]*(?::[ \t]*[A-Za-z_][\w.\[\]<>]*[ \t]*(?==[^=]))?(?:=>|:=|[=:](?![=:]))[ \t]*
        (?:(?P<quoted>(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
              (?:[ \t]*\+?[ \t]*(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'))*)
          |(?P<bare>[A-Za-z0-9_$+/.=~!@%^&*-]+))""", re.X)
PART = re.compile(r""""((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'""")
IDENTIFIER = re.compile(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_]\w*)*")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

#: How much a word in a name tells that the value is secret.
WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.7, "private": 0.5,
    "access": 0.4, "api": 0.4, "key": 0.5, "signing": 0.4, "encryption": 0.4, "salt": 0.5,
    "session": 0.4, "cookie": 0.4, "dsn": 0.4, "pass": 0.6,
}
#: Words in a name that say the value only describes or locates a secret.
DAMPERS = {"name", "path", "file", "url", "uri", "type", "length", "len", "size", "count", "field", "label",
           "prompt", "hint", "policy", "expires", "expiry", "ttl", "id", "header", "param", "env", "public"}
PLACEHOLDERS = {"changeme", "password", "secret", "token", "example", "placeholder", "none", "null", "true",
                "false", "undefined", "todo", "xxxxxx", "test", "string", "your"}
#: Whole values that a program fills in: ${NAME}, $NAME, $(command), %(name)s, %NAME%, {{name}}, {name}, <name>.
TEMPLATE = re.compile(r"\$\{[^{}]*\}|\$(?:[A-Z_][A-Z0-9_]*|[a-z_]+)|\$\([^()]*\)|%\(\w+\)[sdr]|%\w+%|\{\{[^{}]*\}\}|\{[\w.]*\}|<[^<>]*>")
THRESHOLD = 0.9
MIN_LITERAL = 6


def name_score(name: str) -> float:
    """0 for a harmless name; 0.9 and more for one that names a secret."""
    words = [w.lower() for w in WORD.findall(name)]
    score = sum(WEIGHTS.get(w, 0.0) for w in words)
    return 0.0 if score < 0.5 or any(w in DAMPERS for w in words[-1:]) else min(score, 2.0)


def literal_score(value: str) -> float:
    """What a literal itself adds: its length, mix of characters and entropy."""
    if len(value) < MIN_LITERAL or any(c.isspace() for c in value):
        return -1.0
    low = value.lower()
    if low in PLACEHOLDERS or TEMPLATE.fullmatch(value) or len(set(value)) <= 2 or low.startswith(("http:", "https:", "file:")):
        return -1.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(any(test(c) for c in value) for test in (str.islower, str.isupper, str.isdigit))
    return 0.15 * min(n, 32) / 32 + 0.15 * min(entropy, 4.0) / 4.0 + 0.1 * (classes >= 2)


def assignments(text: str):
    """Matches of PAIR, line by line; lines without an assignment sign are skipped."""
    start = 0
    while start <= len(text):
        end = text.find("\n", start)
        end = len(text) if end < 0 else end
        if text.find("=", start, end) >= 0 or text.find(":", start, end) >= 0:
            yield from PAIR.finditer(text, start, end)
        start = end + 1


def lexed_pairs(text: str) -> list[tuple[str, str, list[tuple[int, int]], str]]:
    """(name, value, spans of the value's parts, name on the right or '') of each assignment."""
    found = []
    for m in assignments(text):
        name = m["name"].strip("\"'").lstrip("-")
        if m["quoted"] is not None:
            spans, value = [], ""
            for p in PART.finditer(m["quoted"]):
                g = 1 if p[1] is not None else 2
                value += p[g]
                spans.append((m.start("quoted") + p.start(g), m.start("quoted") + p.end(g)))
            found.append((name, value, spans, ""))
        else:
            bare = m["bare"]
            right = bare if IDENTIFIER.fullmatch(bare) else ""
            found.append((name, bare, [(m.start("bare"), m.end("bare"))], right))
    return found


def reached_scores(names: set[str], sources: dict[str, list[str]]) -> dict[str, float]:
    """For each name that reaches a sensitive one, the largest score among those that its constant reaches.

    Scores are pushed back along the assignments, the highest first, so each name is settled once and each
    assignment is followed once.
    """
    scores = sorted(((name_score(n), n) for n in names), reverse=True)
    reach: dict[str, float] = {}
    for score, name in scores:
        if score <= 0:
            break
        todo = [name]
        while todo:
            at = todo.pop()
            if at not in reach:
                reach[at] = score
                todo += sources.get(at, ())
    return reach


def literal_spans(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name, directly or through constants."""
    if "=" not in text and ":" not in text:
        return []
    pairs = lexed_pairs(text)
    if not pairs:
        return []
    # Constants flow from the name on the right to the name on the left.
    defined = {name for name, _, _, _ in pairs}
    sources: dict[str, list[str]] = {}
    for name, _, _, right in pairs:
        if right and right in defined and right != name:
            sources.setdefault(name, []).append(right)
    reach = reached_scores(defined, sources)

    out = []
    for name, value, spans, right in pairs:
        if right and right in defined and right != name:
            continue  # a reference; its constant is reported where it stands
        quality = literal_score(value)
        if quality >= 0 and (s := reach.get(name, 0.0)) and s + quality >= THRESHOLD:
            out += [span for span in spans if span[1] > span[0]]
    return sorted(set(out))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the three base kinds, by start and then kind."""
    out, low = [], text.lower()
    if any(word in low for word in ("passw", "secret", "token", "api")):  # else ASSIGN can't match
        out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(a, KINDS[k], b) for a, k, b in sorted(out)]


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def scan(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """The base spans and all spans of one text."""
    base = base_spans(text)
    order = {k: i for i, k in enumerate(KINDS)}
    every = base + [(a, "literal", b) for a, b in literal_spans(text)]
    return base, sorted(every, key=lambda s: (s[0], order[s[1]], s[2]))


SPANS_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the three base counts, the digest of the base spans, and all spans as an array of structs."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = [scan(t) if t else ([], []) for t in batch.column(1).to_pylist()]
                kinds = [Counter(s[1] for s in base) for base, _ in rows]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0),
                    *(pa.array([k[kind] for k in kinds], pa.int64()) for kind in KINDS[:3]),
                    pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows], pa.string()),
                    pa.array([[{"kind": k, "start": a, "end": b} for a, k, b in every] for _, every in rows], SPANS_TYPE),
                ], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "found"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(
        run, f"doc_id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, "
             "found array<struct<kind:string,start:bigint,end:bigint>>")


def secrets_query(docs: DataFrame) -> DataFrame:
    """Digest columns of ``scan_secrets``: the spans joined as ``kind:start:end``."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return scan_secrets(docs).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
        F.array_join(F.transform("found", one), ",").alias("spans"))
