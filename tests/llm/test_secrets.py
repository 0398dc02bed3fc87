"""Secret scan: base spans against the plain patterns, lexing, propagation, edge cases."""

import hashlib
import random
import time
import re

from gridwatch.llm import secrets as S
from gridwatch.llm.common import load

PLAIN = {
    "assign": re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in pattern.finditer(text):
            size = len(m[2]) if kind == "assign" else len(m[0])
            if size >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                out.append((m.start(), k, kind, m.end()))
    return [(a, kind, b) for a, _, kind, b in sorted(out)]


HEX = "0123456789abcdef" * 3
TEXTS = [
    "", "password=abc token=\"token\"=abcdefg", 'PASSWORD : "hunter2hunter2"', "api_key=x" + HEX, f"é🙂 secret: {HEX}", "AKIA" + "A" * 15,
    "AKIA" + "A" * 16, "xAKIAKIA" + "B9" * 10, HEX[:23], HEX[:24] + "G" + HEX, "token==abcdef", "token= =abcdef", "Kapi_key:'abcdef'", "paſſword=abcdefgh",
    "token=token=abcdef", "secret=.=abc;passwd:abcdef",
]


def test_base_spans_are_those_of_the_plain_patterns():
    for text in [*TEXTS, "\n".join(TEXTS), " ".join(TEXTS)]:
        assert S.base_spans(text) == brute(text), text


def found(text):
    return [text[a:b] for a, b in S.literal_spans(text)]


def test_lexed_literals():
    assert found('db_pwd = "s3cr3t-Value9"') == ["s3cr3t-Value9"]
    assert found("clientSecret: 'aB3dE6gH9'") == ["aB3dE6gH9"]
    assert found('config["private_key"] = "MIIEpAIBAAKCAQEA7"') == ["MIIEpAIBAAKCAQEA7"]
    assert found("const authToken: string = \"abcD1234efgh\";") == ["abcD1234efgh"]
    assert found("--db-password=Xy7Zw8Qp") == ["Xy7Zw8Qp"]
    assert found('password => "tr0ub4dor3"') == ["tr0ub4dor3"]
    assert found('secret_key = "abcdef12" + "3456ghij"') == ["abcdef12", "3456ghij"]


def test_constants_are_propagated():
    text = 'A = "Zx81kk20qq"\nB = A\nfoo = "plainvalue1"\npassword = B\n'
    assert found(text) == ["Zx81kk20qq"]
    assert found('password = B\nB = "Zx81kk20qq"') == ["Zx81kk20qq"]
    assert found('a = b\nb = a\npassword = a') == []


def test_harmless_names_and_placeholders():
    for text in ('title = "correcthorse"', 'password = "changeme"', 'password_file = "etcpasswordfile"', 'token_type: "bearerbearer"',
                 'password = "<your password>"', 'secret = "${SECRET_VALUE}"', "a = b", "12:30 and 13:45"):
        assert found(text) == [], text


def test_query(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[2]), (90, None), (91, "word " * 200000 + 'pwd = "Qw3rTy77xx"'), (3, TEXTS[3]), (3, TEXTS[3])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_hex int, spans string")
    want = []
    for i, t in rows:
        spans = brute(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for a, k, b in spans)
        n = [sum(k == kind for _, k, _ in spans) for kind in PLAIN]
        want.append((i, *n, hashlib.sha256(joined.encode()).hexdigest()))
    out = S.secrets_query(df.repartition(3)).collect()
    assert sorted([tuple(r)[:5] for r in out], key=str) == sorted(want, key=str)
    for r in out:
        every = [x.split(":") for x in r.spans.split(",") if x]
        base = [f"{k}:{a}:{b}" for k, a, b in every if k in PLAIN]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256
        assert [int(x[1]) for x in every] == sorted(int(x[1]) for x in every)
    assert any("literal" in r.spans for r in out if r.doc_id == 91)
    assert S.secrets_query(df.limit(0)).count() == 0


def test_documents(spark):
    df = load(spark, "/root/testdata/sf0.001", "documents")
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in S.secrets_query(df).collect():
        spans = brute(texts[r.doc_id] or "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for _, k, _ in spans) for kind in PLAIN)


def test_only_whole_templates_are_placeholders():
    hashed = "$2b$12$" + "EixZaYVK1fsbw1ZfbX3OXe"
    for value in (hashed, "%9xK!vQ2mLw8", "{Zr7kQ9vT1pL", "<Zr7kQ9vT1pL", "Zr7kQ9vT1pL}", "Zr7kQ9vT1pL>"):
        text = f'password = "{value}"'
        assert [text[a:b] for a, b in S.literal_spans(text)] == [value]
    for value in ("${DB_PASSWORD}", "$DB_PASSWORD", "%(password)s", "%DB_PASSWORD%", "{{ db_password }}", "{{db_password}}", "<db_password>"):
        assert S.literal_spans(f'password = "{value}"') == []


def test_long_chain_of_constants():
    """1 MB of constants that flow through each other: each assignment is followed once."""
    lines = ['c0 = "Zr7kQ9vT1pLm"'] + [f"c{i} = c{i - 1}" for i in range(1, 40_000)] + ["db_password = c39999"]
    text = "\n".join(lines) + "\n" + "\n".join(f"filler_{i} = other_{i}" for i in range(16_000))
    assert len(text) > 1_000_000
    began = time.process_time()
    assert [text[a:b] for a, b in S.literal_spans(text)] == ["Zr7kQ9vT1pLm"]
    assert time.process_time() - began < 10


def test_scores_flow_as_by_search():
    rng = random.Random(8)
    for _ in range(100):
        names = ["a", "b", "c", "d", "my_token", "db_password", "x_secret", "key"]
        sources = {n: rng.choices(names, k=rng.randint(0, 2)) for n in names}

        def reaches(start, sources=sources, names=names):
            seen, todo = {start}, [start]
            while todo:
                at = todo.pop()
                for n in names:
                    if at in sources[n] and n not in seen:
                        seen.add(n)
                        todo.append(n)
            return max(S.name_score(n) for n in seen)

        got = S.reached_scores(set(names), sources)
        assert all(got.get(n, 0.0) == reaches(n) for n in names)
