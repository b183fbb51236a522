import hashlib
import random
import re

import numpy as np

from llm_fixtures import no_docs, odd  # noqa: F401
from revmine.llm import secret_links as S

AKIA = "AKIA" + "Q7" * 8
HEX = "0123456789abcdef" * 2
OPAQUE = "Zm9vYmFyQmF6UXV4MTIz"


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["id"]: [(s["kind"], s["begin"], s["end"]) for s in r["spans"]] for r in S.spans(df).collect()}


def plain(text):
    """All pairs, one text."""
    parts = []
    for i, k in enumerate(S.KINDS):
        for m in re.finditer(k.pattern, text):
            if len(m[k.group]) >= k.least and (not k.mixed or all(re.search(c, m[0]) for c in ("[A-Z]", "[a-z]", "[0-9]"))):
                parts.append((i, k, m.start(), m.end()))
    over = lambda a, b: a[2] < b[3] and a[3] > b[2]
    mine = [p for p in parts if p[0] < len(S.BASE) or not any(q[0] < p[0] and over(p, q) for q in parts)]
    breaks = [m.end() for m in re.finditer(S.BLANK_LINE, text)]
    scope = lambda p: sum(b <= p[2] for b in breaks)
    near = lambda p, role: any(q[1].role == role and scope(q) == scope(p) and q[2] < p[3] + S.REACH and q[3] > p[2] - S.REACH for q in mine)
    out = []
    for p in mine:
        i, k = p[:2]
        ok = i < len(S.BASE) or (near(p, S.SECRET) if k.role == S.IDENTIFIER else near(p, S.IDENTIFIER) if k.role == S.SECRET else near(p, S.IDENTIFIER) and near(p, S.SECRET))
        if ok:
            out.append((p[2], i, k.name, p[3]))
    return [(name, b, e) for b, _, name, e in sorted(out)]


def test_base_patterns(spark):
    texts = ["PassWord: hunter22", "secret=ab token=abcdef", "secret=token:abcdefgh", "ſecret=abcdefgh", "api-key=abcdefgh apikey='abcdefgh' API_KEY:=x", AKIA + " " + AKIA[:19],
             HEX[:24] + " " + HEX[:23], "é😀 token = \"" + HEX + '"', None, ""]
    got = found(spark, texts)
    assert got == {i: plain(t or "") for i, t in enumerate(texts)}
    assert got[0] == [("assign", 0, 18)] and got[2] == [] and got[3] == [] and got[5] == [("access", 0, 20)] and got[6] == [("hex", 0, 24)]
    assert got[7][0] == ("assign", 3, 3 + 9 + 32) and got[7][1][0] == "hex"


def test_weak_parts_need_their_complement(spark):
    url = "https://db.example.org/x"
    texts = [f"login: anna {OPAQUE}", f"login: anna\n\n{OPAQUE}", f"login: anna {'.' * S.REACH}{OPAQUE}", f"login: anna{'.' * 0} {url}", f"{url} login=anna pwd=abcd", f"{AKIA} {OPAQUE}", OPAQUE, url,
             f"user={OPAQUE}", f"pass={OPAQUE} and {url}"]
    got = found(spark, texts)
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    names = {i: [s[0] for s in v] for i, v in got.items()}
    assert names[0] == ["login", "opaque"] and names[1] == names[2] == names[3] == names[6] == names[7] == names[8] == names[9] == []
    assert names[4] == ["endpoint", "login", "phrase"] and names[5] == ["access", "opaque"]


def test_reach_is_measured_between_the_nearest_ends(spark):
    # 'login: bob' ends before the gap; one code point decides
    near, far = (f"login: bob{' ' * n}{OPAQUE}" for n in (S.REACH - 1, S.REACH))
    assert [len(v) for v in found(spark, [near, far]).values()] == [2, 0]


def test_equals_all_pairs(spark):
    rng = random.Random(3)
    bits = ["login: anna", "pwd=abcd", OPAQUE, HEX, AKIA, "https://a.example/b", "token=abcdef", "\n\n", "\n \n", " lorem ipsum dolor " * 4, ". ", "é😀", "user=" + OPAQUE, "\n"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randrange(0, 30))) for _ in range(150)]
    assert found(spark, texts) == {i: plain(t) for i, t in enumerate(texts)}


def test_overlaps_are_counted_without_pairs():
    rng = np.random.default_rng(5)
    for _ in range(50):
        b, p = (rng.integers(0, 60, (n, 2)) for n in (20, 7))
        b, p = (np.sort(x, axis=1) + [0, 1] for x in (b, p))
        want = [sum(x < d and y > c for x, y in b) for c, d in p]
        assert S._overlap(np.sort(b[:, 0]), np.sort(b[:, 1]), p[:, 0], p[:, 1]).tolist() == want


def test_very_long_text(spark):
    text = ("login: anna " + OPAQUE + " ") * 20_000
    got = found(spark, [text])[0]
    assert len(got) == 40_000


def test_odd_rows_and_empty_tables(spark, odd, no_docs):
    rows = S.digests(S.spans(odd)).collect()
    none = hashlib.sha256(b"").hexdigest()
    assert len(rows) == odd.count() and {(r["n_assign"], r["base_sha256"], r["spans"], r["n_linked"]) for r in rows} == {(0, none, "", 0)}
    assert S.digests(S.spans(no_docs)).collect() == []
