"""The audit of filters against the filters themselves, applied in every order."""

import itertools
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sessionlens.llm import filter_audit

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


def plain(docs, labels):
    first, good, toxic = {}, set(), set()
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    for i, q, t in labels:
        good |= {i} if q == 1 and i is not None else set()
        toxic |= {i} if t == 1 and i is not None else set()

    def fails(i, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        signs = len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text))
        return {x for x, f in zip("ABCDE", (*signs, i is not None and first[text] < i), strict=True) if f}

    parts = defaultdict(list)
    for i, text, lang in docs:
        parts[lang or ""].append((i, fails(i, text or "")))
    out, shapley = [], Counter()
    for part, rows in parts.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for step, x in enumerate(order, 1):
                here = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                shapley[part, x] += len(here)
                failing = sum(x in f for _, f in rows)
                out.append([part, order, step, len(left), len(here), failing - len(here), sum(f == {x} for _, f in rows), sum(i in good for i, _ in here), sum(i in toxic for i, _ in here)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def made(spark, docs, labels):
    return sorted(map(tuple, filter_audit.audit_filters(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)).collect()))


def test_equals_filters_in_order(spark):
    rng = random.Random(3)
    few, many = [f"w{i}" for i in range(40)], [f"v{i}" for i in range(2000)]
    texts = [" ".join(rng.choices(rng.choice([few, many]), k=rng.randrange(80, 130))) for _ in range(60)]
    texts += [t.upper() for t in texts[:20]] + [t + " $" for t in texts[20:40]] + ["", "x" * 200_000, "\x0b\t A\x1cB é Z", "A b c d e f g h i", "ÀÉ A"]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", "", None])) for i in range(400)]
    docs += [(400 + i, texts[0], "en") for i in range(200)] + [(None, texts[0], "fr"), (None, None, None), (-5, None, "en"), (7, texts[0], "de")]
    docs += [docs[3], docs[3], (min(i for i, t, _ in docs if i is not None and t == texts[0]), texts[0], "only here")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 500, 2)] + [(2, 1, 1), (4, 0, 0), (None, 1, 1)]
    assert made(spark, docs, labels) == plain(docs, labels)


def test_empty_and_other_columns(spark):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit_filters(spark.createDataFrame([], DOCS), labels).count() == 0
    docs = spark.createDataFrame([(1, "a", "en", 9, 9)], DOCS + ", mask int, quality int")
    got = filter_audit.audit_filters(docs, labels)
    assert got.count() == 600 and got.agg(F.max("removed")).first()[0] == 1


def test_steps_are_all_orders():
    assert len(filter_audit.order_steps()) == 600 and len(set(filter_audit.order_steps())) == 600
