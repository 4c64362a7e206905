"""The combined automaton against Python's regex engine."""

import hashlib
import random
import re
import time

from sessionlens.llm import secrets

TABLE = "/root/testdata/sf0.001/documents.parquet"
#: Patterns and least lengths once more, the length that counts in a group.
PATTERNS = {k: (re.compile(re.sub(r"(\[A-Za-z0-9\+/_\.=-\]\+)$", r"(\1)", p) if tail else f"({p})", re.ASCII), least) for k, (p, least, tail) in secrets.RULES.items()}


def brute(text):
    kinds = list(PATTERNS)
    out = [(m.start(), kinds.index(k), m.end()) for k, (p, least) in PATTERNS.items() for m in p.finditer(text) if len(m[1]) >= least]
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(out))


def odd_texts(n):
    r = random.Random(5)
    bits = ["password", "PassWd", "toKen", "api_key", "apikey", "secret", '"', "'", " ", "  ", ":", "=", "==", "AKIA", "ABCDEF0123456789", "0123456789abcdef", "ghp_", "xoxb-", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "é", "漢", "\n", ",", ".", "a", "Z9", "_", "-", "+/", "x" * 30]
    return ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_scan_equals_the_regex_engine(spark, monkeypatch):
    texts = [*odd_texts(3000), *(r["text"] for r in spark.read.parquet(TABLE).collect()), None, ""]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    for r in secrets.secret_digest(secrets.scan_secrets(df)).collect():
        want = brute(texts[r["doc_id"]] or "")
        assert r["spans"] == want
        base = [s for s in want.split(",") if s.split(":")[0] in secrets.BASE]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s.startswith(f"{k}:") for s in base) for k in secrets.BASE)
    assert sum(brute(t or "") != "" for t in texts) > 300


def test_automaton_is_small_and_linear():
    auto = secrets.Automaton(secrets.RULES)
    assert auto.states < 600 and len(auto.rows) < 100  # of the scan, and of the automaton begun at one place
    for text in (b"0123456789abcdef" * 640_000, b"token " * 1_700_000):  # 10 MB without a sync byte
        began = time.process_time()
        start, end, found = auto.hits(secrets.np.frombuffer(text, secrets.np.uint8), secrets.np.array([0, len(text)]))
        got = [secrets.spans_in(text, [(int(a), int(b), int(m))], list(secrets.RULES), auto) for a, b, m in zip(start, end, found, strict=True)]
        assert time.process_time() - began < 20
        assert sum(got, []) == ([(0, "hex", len(text))] if text[0] == 48 else [])
