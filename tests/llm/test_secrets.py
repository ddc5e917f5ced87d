"""Secret scans: base spans against the plain patterns, the lexer against known assignments."""
import hashlib
import re

import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from samples import nothing, odd, prose

from touchline.llm import queries, secrets
from touchline.llm.shared import documents

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def plain_spans(text):
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[0], s[2]))


PIECES = st.sampled_from(["password", "PassWd", "secret", "token", "apikey", "api_key", "AKIA", "ABCDEF0123456789", ":", "=", " ", "\'", '"', "abc", "0123456789abcdef", "\u017f", "\n", "{", "(", ","])


@settings(max_examples=1500, deadline=None)
@given(st.lists(PIECES, max_size=16).map("".join))
def test_base_spans_equal_the_plain_patterns(text):
    base, added = secrets.all_spans(text)
    assert base == plain_spans(text)
    assert all(0 <= a < b <= len(text) and not any(x <= a and b <= y for x, y, _ in base) for a, b, _ in added)


FOUND = [
    ('db_passwd_prod = "hunter2xyz"', ["hunter2xyz"]),                                  # a sensitive part of a longer name
    ("my_pwd: Tr0ub4dor&3", ["Tr0ub4dor&3"]),                                            # a bare value
    ('{"clientSecret": "aZ9 kk!!pq", "title": "abcdef123456"}', ["aZ9 kk!!pq"]),          # one key of two
    ('K = "s3cr3t" + "P2"\npw2 = K\nuser_pwd = pw2', ["s3cr3t", "P2"]),                  # constants, through two names, joined
    ('cred = base\nbase = "late1-def"', ["late1-def"]),                                  # defined behind its use
    ("export DB_PASS=correcthorse", ["correcthorse"]),
    ("config[\"auth_key\"] = 'Zx81Qw!2'", ["Zx81Qw!2"]),
    ('login_pwd: str = "opensesame1"', ["opensesame1"]),
    ('const authKey: string | undefined = "AbC123xyz";', ["AbC123xyz"]),
    ('<add key="ApiPwd" value="qw8er!ty7"/>', ["qw8er!ty7"]),
    ("<db_pass>pl4intext!</db_pass>", ["pl4intext!"]),
    ('c.setProperty("pwd", "s3tMe!now")', ["s3tMe!now"]),
    ("mysql --passphrase hunter22x --user bob", ["hunter22x"]),
    ('x = os.getenv("DB_PWD", "fallb4ck!"); credentials = x', ["fallb4ck!"]),
    ('auth = b64decode("Zm9vYmFyMTIz")', ["Zm9vYmFyMTIz"]),
    ("pwd => 'ph9pArrow!'", ["ph9pArrow!"]),
    ("- name: SMTP_PWD\n  value: m4ilPa55x", ["m4ilPa55x"]),
    ('public_key = "abcdef123456"', []),
    ('pwd = os.environ.get("DB_PWD")', []),
    ("pwd: changeme", []),
    ('pwd_prompt = "Enter it now"', []),
    ('pwd: "Enter your password"', []),
    ("pwd=self.pwd", []),
    ('if pwd == "comparison1": pass', []),
    ('title = "abcdef123456"', []),
]


@pytest.mark.parametrize(("text", "expect"), FOUND)
def test_literals_of_sensitive_names(text, expect):
    base, added = secrets.all_spans(f"{prose(3, 9)}\n{text}\n{prose(4, 9)}")
    assert not base
    full = f"{prose(3, 9)}\n{text}\n{prose(4, 9)}"
    assert [full[a:b] for a, b, _ in added] == expect


def test_prose_is_left_alone_and_work_is_linear():
    assert secrets.all_spans(" ".join(prose(i, 500) for i in range(20))) == ([], [])
    long = "".join(f"v{i} = v{i + 1} + v{i + 1}\n" for i in range(20_000)) + 'v20000 = "deep1-const"\npwd = v0\n'  # doubling, 20,000 names deep
    assert [long[a:b] for a, b, _ in secrets.all_spans(long)[1]] == ["deep1-const"]
    for text in ("=" * 200_000, "token" + " " * 200_000 + "=", '="' * 100_000, "pwd=`" * 50_000, "a:" * 100_000, "pwd=" + "a." * 100_000, "pwd=f(" * 50_000):
        assert secrets.base_spans(text) == plain_spans(text)
        secrets.all_spans(text)


def test_found_and_redacted_on_odd_rows(spark):
    df, data = odd(spark)
    out = secrets.found(df).collect()
    assert len(out) == len(data) and all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() and r["spans"] == "" for r in out)
    kept = secrets.redacted(df)
    assert kept.columns == df.columns and sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))
    assert secrets.found(nothing(spark)).count() == 0
    one = spark.createDataFrame([(1, 'x = "late1-def" pwd = x, token: abcdef99', "en", "s", 28)], nothing(spark).schema)
    assert secrets.redacted(one).first()["text"] == 'x = "[SECRET]" pwd = x, [SECRET]'
    assert secrets.found(one).first()["spans"] == "assign:5:14,assign:25:40"


def test_query_equals_the_plain_patterns(spark):
    d = SF.replace("0.001", "0.01")
    texts = {r["doc_id"]: r["text"] or "" for r in documents(spark, d).collect()}
    out = queries.op12_secret_scan(spark, d).collect()
    assert len(out) == len(texts)
    for r in out:
        spans = plain_spans(texts[r["doc_id"]])
        digest = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, b, k in spans)
        assert r["base_sha256"] == hashlib.sha256(digest.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for *_, k in spans) for x in range(3)]
        assert r["spans"].count(":") // 2 == len(spans) + r["n_added"]
    assert sum(r["n_assign"] for r in out) and sum(r["n_hex"] for r in out)
