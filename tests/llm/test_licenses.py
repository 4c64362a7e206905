"""Licences reach everything below their directory, from the top of a tree too."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from sessionlens.llm import licenses

MIT, GPL = licenses.NOTICES["MIT"], licenses.NOTICES["GPL-3.0"]


def scan(spark, files):
    rows = licenses.scan_licenses(spark.createDataFrame(files, "path string, text string")).collect()
    return {r.path: (r.license, r.how, r.from_dir) for r in rows}


def test_top_level_licence_of_a_relative_tree(spark):
    got = scan(spark, [("LICENSE", MIT), ("README", ""), ("src/a.py", ""), ("src/deep/b.py", ""), ("lib/COPYING", GPL), ("lib/x/c.c", ""), ("/abs/d.c", ""), (None, MIT)])
    below = ("MIT", "inherited", "")
    assert got == {
        "LICENSE": ("MIT", "header", None),
        "README": below,
        "src/a.py": below,
        "src/deep/b.py": below,
        "lib/COPYING": ("GPL-3.0", "header", None),
        "lib/x/c.c": ("GPL-3.0", "inherited", "lib"),
        "/abs/d.c": (None, "none", None),
        None: (None, "none", None),
    }


def test_top_level_licence_of_an_absolute_tree(spark):
    got = scan(spark, [("/LICENSE", GPL), ("/src/deep/b.py", ""), ("/c.py", ""), ("src/a.py", "")])
    assert got["/src/deep/b.py"] == got["/c.py"] == ("GPL-3.0", "inherited", "") and got["src/a.py"] == (None, "none", None)


def test_usual_headers_and_licence_files(spark):
    mit = licenses.TEXTS["MIT"].replace("Copyright (c)", "\n\nCopyright (c) 2021 Some Body\n\n").replace(", ", ",\n")
    bsd = licenses.TEXTS["BSD-3-Clause"].replace("reserved.", "reserved.\n\n").replace("; ", ";\n")
    apache = licenses.TEXTS["Apache-2.0"].replace(";", ";\n *").replace(". You", ".\n * You").replace(" at ", " at\n *\n *    ")
    files = [("m/LICENSE", mit), ("m/x/y/z.py", "x"), ("b/COPYING", bsd), ("a/a.c", f"/*\n * Copyright Some Body\n *\n * {apache}\n */\nint x;"), ("g/LICENSE", "   GNU GENERAL PUBLIC LICENSE\n    Version 3, 29 June 2007\n\n Preamble"), ("s.py", "#!/bin/x\n# SPDX-License-Identifier: BSD-2-Clause\n" + "word " * 100_000), ("z.py", "# SPDX-License-Identifier: Zlib"), ("p.txt", "the license of the driver was revoked")]
    got = scan(spark, files)
    assert got == {"m/LICENSE": ("MIT", "header", None), "m/x/y/z.py": ("MIT", "inherited", "m"), "b/COPYING": ("BSD-3-Clause", "header", None), "a/a.c": ("Apache-2.0", "header", None), "g/LICENSE": ("GPL-3.0", "header", None), "s.py": ("BSD-2-Clause", "header", None), "z.py": (None, "none", None), "p.txt": (None, "none", None)}


def test_signature_loses_nothing_and_empty_table(spark):
    rows, idf, _ = licenses.template_vectors(licenses.TEMPLATES)
    must = set(licenses.signature(rows, 0.8))
    for k in {(k, i) for k, i, _, _ in rows}:
        assert sum(w * w for a, i, t, w in rows if (a, i) == k and t in must) > 1 - 0.8**2
    empty = spark.createDataFrame([], "path string, text string")
    assert licenses.scan_licenses(empty).count() == 0 and scan(spark, [("a", None), ("b", "")]) == {"a": (None, "none", None), "b": (None, "none", None)}


def test_rows_of_one_path_do_not_mix(spark):
    """Two texts of a path are scored apart; rows that repeat change no score; of licences with equal scores the smaller name counts."""
    alone = licenses.scan_licenses(spark.createDataFrame([("a/x", licenses.TEXTS["MIT"] + " ok then")], "path string, text string")).first()
    files = [("a/x", licenses.TEXTS["MIT"] + " ok then"), ("a/x", "license " + "other words " * 50), ("b/x", MIT), ("b/x", GPL)] + [("c/x", licenses.TEXTS["MIT"] + " ok then")] * 3
    rows = licenses.scan_licenses(spark.createDataFrame(files, "path string, text string").repartition(4)).collect()
    assert sorted((r.path, r.license, r.score) for r in rows) == [("a/x", "MIT", alone.score)] * 2 + [("b/x", "GPL-3.0", 1.0)] * 2 + [("c/x", "MIT", alone.score)] * 3


def test_parts_that_cannot_match_are_not_dealt_out(spark, monkeypatch):
    """Prose that holds a word of a template has no row among the terms; what matches has all of its."""
    dealt = []
    real = licenses.materialize
    monkeypatch.setattr(licenses, "materialize", lambda df, name: dealt.append((name, out := real(df, name))) or out)
    prose = "\n".join(" ".join(f"wort{chr(97 + i % 26)}{chr(97 + j)}" for j in range(20)) + " mit der license in the software" for i in range(50))
    files = spark.createDataFrame([(f"a/{i}.txt", prose) for i in range(20)] + [("b/x", "intro\n\n" + MIT)], "path string, text string")
    assert [(r.path, r.license) for r in licenses.notice_scores(files).collect()] == [("b/x", "MIT")]
    assert {r.path for r in dict(dealt)["terms"].collect()} == {"b/x"}


def test_bound_loses_no_match(spark):
    rows, idf, unseen = licenses.template_vectors(licenses.TEMPLATES)
    vectors = {}
    for k, i, t, w in rows:
        vectors.setdefault((k, i), {})[t] = w
    draw, texts = random.Random(1), ["", "...", "zzz"]
    for _ in range(1500):
        words = list(draw.choice(list(vectors.values()))) * draw.choice([1, 1, 2, 40])
        words += [f"u{chr(97 + draw.randrange(26))}{chr(97 + draw.randrange(26))}" for _ in range(draw.randrange(draw.choice([3, 10, 40])))] + draw.choices(list(idf), k=draw.choice([0, 5, 30]))
        texts.append(" ".join(words))

    def best(text):
        bag = {t: (1 + math.log(n)) * idf.get(t, unseen) for t, n in Counter(re.findall(licenses.TERM, text)).items()}
        norm = math.sqrt(sum(w * w for w in bag.values()))
        return max(sum(w * v.get(t, 0.0) for t, w in bag.items()) for v in vectors.values()) / norm if norm else 0.0

    kept = spark.createDataFrame(list(enumerate(texts)), "i int, text string").where(licenses.may_match(F.col("text"), idf, unseen, 0.8 - 1e-6)).collect()
    match = {i for i, t in enumerate(texts) if round(best(t), 6) >= 0.8}
    assert 100 < len(match) < len(texts) - 100 and match <= {r.i for r in kept} and len(kept) < len(texts)
    must = re.compile(rf"(?<![a-z])(?:{licenses.any_of(licenses.signature(rows, 0.8))})(?![a-z])")
    assert all(must.search(f"x {w}, y") and not must.search(f"{w}x") for w in licenses.signature(rows, 0.8) if w.isalpha())
