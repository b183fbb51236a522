import random
import re

import numpy as np
import pytest

from llm_fixtures import no_docs, odd  # noqa: F401
from revmine.llm import license_scan as LS

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = ALNUM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def brute(text, templates):
    s = shingles(text)
    found = []
    for name, texts in templates.items():
        for t in texts:
            want = shingles(t)
            if not want:
                continue
            step = 1 << (len(want) - 1).bit_length()
            for at in range(0, len(s), step):
                both = set(want) & set(s[at:at + 2 * step])
                if 100 * len(both) >= 75 * len(set(want)):
                    found.append((name, at, at + 2 * step, both, set(want)))
    out = {}
    for name, a, b, both, want in found:
        if not any(o[0] != name and o[1] < b and a < o[2] and len(o[3]) * len(want) > len(both) * len(o[4]) and 100 * len(both & o[4]) >= 75 * len(both) for o in found):
            out[name] = min(a, out.get(name, a))
    return [(n, out[n]) for n in sorted(out)]


def test_equals_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(300)]
    notices = [t for texts in LS.TEMPLATES.values() for t in texts]
    docs = []
    for i in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 200))]
        for _ in range(rng.randrange(0, 3)):
            n = rng.choice(notices).split()
            for _ in range(rng.randrange(0, 2 + len(n) // 10)):
                n[rng.randrange(len(n))] = rng.choice(vocab)
            at = rng.randrange(len(w) + 1)
            w[at:at] = n
        docs.append((i, " ".join(w)))
    got = {r["id"]: list(zip(r["licenses"], r["windows"], strict=True)) for r in LS.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: brute(t, LS.TEMPLATES) for i, t in docs}
    assert sum(map(bool, got.values())) > 40


@pytest.mark.parametrize("similarity", [0.18, 0.33, 0.5])
def test_bands_keep_the_promise(similarity):
    n = LS.bands_for(similarity)
    assert (1 - similarity) ** n <= LS.MISS < (1 - similarity) ** (n - 1)


def test_windows_hold_every_place(spark):
    """A notice is found wherever it begins, also at a text's very start and end."""
    notice = LS.TEMPLATES["GPL-3.0"][1]
    docs = [(k, "x " * k + notice + " y" * (40 - k)) for k in range(41)]
    got = LS.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(r["licenses"] == ["GPL-3.0"] for r in got)


def test_odd_rows_and_templates(spark, odd, no_docs):
    templates = {"b": ["one"], "a": ["", "...", "two WORDS!"], "empty": []}
    rows = odd.select("doc_id", "text").collect()
    got = sorted((str(r["id"]), r["licenses"]) for r in LS.scan(odd, templates).collect())
    assert got == sorted((str(r["doc_id"]), [n for n, _ in brute(r["text"], templates)]) for r in rows)
    assert LS.scan(no_docs).collect() == []
    assert all(r["licenses"] == [] for r in LS.scan(odd, {}).collect())
    assert np.array_equal(np.unique(LS._ODD % np.uint64(2)), [1])


def test_short_wordings_and_other_licenses(spark):
    """The usual wordings are found, and no notice passes for another license."""
    wordings = [("Licensed under the MIT License", ["MIT"]), ("Licensed under the BSD 3-Clause License", ["BSD-3-Clause"]),
                ("Licensed under the Mozilla Public License, version 2.0", ["MPL-2.0"]), ("Licensed under CC BY-SA 4.0", ["CC-BY-SA-4.0"]),
                ("Licensed under the GNU Lesser General Public License", ["LGPL"]), ("Licensed under the GNU Affero General Public License", ["AGPL"]),
                ("CC0 1.0 Universal (CC0 1.0) Public Domain Dedication", ["CC0-1.0"]),
                (LS.TEMPLATES["GPL-2.0"][1].replace(";", ","), ["GPL-2.0"]), (LS.TEMPLATES["GPL-2.0"][0] + " " + LS.TEMPLATES["MIT"][0], ["GPL-2.0", "MIT"]),
                (LS.TEMPLATES["GPL-2.0"][1] + " word " * 60 + LS.TEMPLATES["GPL-3.0"][1], ["GPL-2.0", "GPL-3.0"]),
                ("This work is licensed under the GNU General Public License, version", ["GPL-2.0", "GPL-3.0"])]
    wordings += [(t, [name]) for name, texts in LS.TEMPLATES.items() for t in texts]
    docs = [(i, f"some words before it {t} and after it") for i, (t, _) in enumerate(wordings)]
    got = {r["id"]: r["licenses"] for r in LS.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [(wordings[i][0], got[i]) for i in sorted(got)] == wordings
