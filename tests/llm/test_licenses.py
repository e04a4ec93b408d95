import math
import re
from collections import Counter

from pyspark.sql import functions as F

from cairn.llm import licenses as L
from cairn.llm.queries import QUERIES
from tests.llm.util import awkward, frame, prose


def words(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def brute(texts):
    """Best passage of each text by trying every line and run of lines without any screen."""
    templates = [(n, Counter(words(t))) for n, t in L.TEMPLATES]
    known = {w for _, c in templates for w in c}
    idf = {w: math.log((len(texts) + 1) / (sum(w in set(words(t)) for t in texts) + 1)) + 0.1 for w in known}
    middle = sorted(idf.values())
    rest = (middle[(len(middle) - 1) // 2] + middle[len(middle) // 2]) / 2
    out = []
    for text in texts:
        lines, best = [words(x) for x in (text or "").split("\n")], None
        full = [i for i, x in enumerate(lines) if x]
        for i in full:
            for span in L.SPANS:
                own = [w for x in lines[i : i + span] for w in x]
                c = Counter(own)
                norm = math.sqrt(sum((n * idf.get(w, rest)) ** 2 for w, n in c.items()))
                for name, t in templates:
                    dot = sum(c[w] * t[w] * idf[w] ** 2 for w in t)
                    cosine = round(dot / norm / math.sqrt(sum((n * idf[w]) ** 2 for w, n in t.items())), 9)
                    if cosine >= L.LEAST and (best is None or cosine > best[1]):
                        best = (name, cosine)
        out.append(best)
    return out


MIT = L.TEMPLATES[4][1]


def files():
    rows = [(100, "/a/LICENSE", MIT.replace(". ", ".\n").replace(", ", ",\n")), (101, "a/b/x.py", prose(1, 50)), (102, "a/b/c/y.py", "Licensed under the Apache License, Version 2.0.\n" + prose(2, 80))]
    rows += [(103, "a/b/c/z.py", prose(3, 20)), (104, "d/e/f.py", prose(4, 20)), (105, "d/COPYING", "This work is licensed under the GNU General Public License, version 3."), (106, "d/COPYING.old", "All rights reserved."), (107, None, prose(5, 10))]
    rows += [(108, "top.txt", "the and of"), (109, "a/b/c/w.py", prose(6, 300) + "\nReleased under the MIT License.")]
    return rows


def test_own_and_inherited(spark):
    df = spark.createDataFrame([(*r, 1) for r in files()], "doc_id long, p string, text string, directory int")
    got = {r.id: r for r in L.scan(df, F.col("p")).collect()}
    assert {i: r.effective_license for i, r in got.items()} == {
        100: "MIT", 101: "MIT", 102: "Apache-2.0", 103: "MIT", 104: "GPL-3.0", 105: "GPL-3.0", 106: "proprietary", 107: None, 108: None, 109: "MIT",
    }
    assert got[103].inherited_from == "/a/" and got[104].inherited_from == "/d/" and got[109].license == "MIT"
    assert (got[102].first_line, got[102].last_line) == (1, 1) and got[109].first_line == 2


def test_against_brute_force(spark):
    texts = [r[2] for r in files()] + [t for _, t in L.TEMPLATES] + [prose(i, 60) + "\n" + L.TEMPLATES[i % len(L.TEMPLATES)][1] + "\n" + prose(i + 50, 30) for i in range(30)]
    texts += ["\n\n" + MIT.replace(", ", ",\n\n"), "all rights", "", None]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    got = {r.id: (r.license, round(r.similarity, 9)) if r.license else None for r in L.scan(frame(spark, rows), F.lit("x/y")).collect()}
    want = brute(texts)
    for i, best in enumerate(want):
        assert (got[i] is None) == (best is None)
        assert best is None or abs(got[i][1] - best[1]) < 1e-6


def test_awkward_rows(spark):
    for wide in (False, True):
        out = L.scan(frame(spark, awkward(), wide), F.concat_ws("/", "source", F.col("doc_id").cast("string"))).collect()
        assert Counter(r.id for r in out) == Counter(r[0] for r in awkward())
        assert all(r.effective_license is None for r in out)
    assert L.scan(frame(spark, []), F.col("source")).collect() == []


def test_whole_table_finds_every_licence_line(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op8_license_scan"](spark, folder).collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        assert (got[i].license is not None) == bool(re.search("(?i)licensed under|released under the|all rights reserved", text or ""))


def test_notices_inside_longer_lines(spark):
    wrapped = L.TEMPLATES[7][1].split()
    want = {
        "Copyright (c) 2020 Foo Corporation. All rights reserved.": "proprietary",
        "The MIT License (MIT)": "MIT",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007": "GPL-3.0",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3": "LGPL",
        "// SPDX-License-Identifier: Apache-2.0 " + prose(1, 30): "Apache-2.0",
        "spdx-license-identifier: CC0-1.0": "CC0-1.0",
        prose(2, 12) + " Released under the MIT License. " + prose(3, 9): "MIT",
        "This project is licensed under the MIT License - see the LICENSE.md file for details": "MIT",
        "Copyright (c) 2020 Foo. All rights reserved. Use under the Apache License, v2.0.": "Apache-2.0",
        prose(4, 90) + " " + MIT.replace("sublicense", "w7") + " " + prose(5, 200): "MIT",
        prose(6, 40) + " " + " ".join(MIT.split()[:60]) + " " + prose(7, 40): "MIT",
        prose(8, 20) + " " + " ".join(wrapped[:6]) + "\n" + " ".join(wrapped[6:]) + " " + prose(9, 20): "GPL-3.0",
        "the license of the software and all the rights to it are under a license": None,
        "Copyright (c) 2020 Foo": None,
        "some rights reserved": None,
        "## License": None,
        "research at MIT under the terms": None,
    }
    rows = [(i, t, "en", "a", 1) for i, t in enumerate([*want, *(prose(100 + i, 50) for i in range(60))])]
    got = {r.id: r for r in L.scan(frame(spark, rows), F.lit("x/y")).collect()}
    assert {t: got[i].license for i, t in enumerate(want)} == want
    assert (got[11].first_line, got[11].last_line) == (1, 2)
