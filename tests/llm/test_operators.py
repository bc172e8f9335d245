"""The training-data operators against brute force, on small tables with nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tabq.llm import decontamination, exact_dedup, jaccard_join, line_dedup, lm_scoring, mixing, pii, quality, sharding, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def frame(spark, rows, parts=3):
    """doc_id, text, source, and columns whose names operators use inside."""
    full = [(i, t, s, "x", 1.0, 7, True) for i, t, s in rows]
    return spark.createDataFrame(full, "doc_id long, text string, source string, lang string, score double, shard long, maybe boolean").repartition(parts)


@pytest.fixture(scope="module")
def odd():
    """Rows that operators tend to trip over."""
    r = random.Random(3)
    vocab = ["alpha", "Beta", "gamma", "délta", "naïve", "1.2.3.4", "a@b.co", "idiot", "der", "und", "###", "😀"]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 3, 5, 12, 60]))), r.choice(["s1", "s2", "s3", None])) for i in range(120)]
    rows += [(i + 200, rows[i][1], "s1") for i in range(20)]  # equal texts
    rows += [(7, rows[7][1], rows[7][2])]  # a repeated row
    rows += [(500, None, None), (501, "", "s1"), (502, " \n\t ", "s2"), (503, "x " * 30_000, "s3"), (504, "y" * 60_000, "s1"), (None, "no id here", "s2"), (None, None, None)]
    return rows


@pytest.fixture(scope="module")
def labels(spark, odd):
    rows = [(i, int("###" not in (t or "")), int("idiot" in (t or ""))) for i, t, _ in odd if i is not None and i < 200]
    rows += [(None, 1, 1), (9999, 0, 0), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# 1
def brute_tiles(a, b, least=5):
    am, bm, out = [0] * len(a), [0] * len(b), 0
    while True:
        best, found = least, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not am[i + n] and not bm[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best:
                    found.append((i, j))
        if not found:
            return out
        for i, j in found:
            if not any(am[i : i + best]) and not any(bm[j : j + best]):
                am[i : i + best] = bm[j : j + best] = [1] * best
                out += best


def test_tiles_agree_with_textbook_tiling():
    r = random.Random(1)
    for _ in range(120):
        a, b = [r.randrange(6) for _ in range(r.randrange(5, 30))], []
        while len(b) < 45:
            i = r.randrange(len(a))
            b += a[i : i + r.randrange(1, 16)] if r.random() < 0.5 else [r.randrange(6) for _ in range(3)]
        assert sum(n for _, _, n in decontamination.tiles(np.array(a), np.array(b))) == brute_tiles(a, b)


def test_decontamination(spark, odd, monkeypatch):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    w = item.split()
    planted = [
        (900, f"before {item.upper()}, after", "s1", True),
        (901, " ".join(w[8:] + ["filler", "words"] + w[:8]), "s1", True),  # reordered
        (902, " ".join(w[:6] + ["x"] * 9), "s1", False),
        (903, "one two. three; four (five) " + " ".join(w[5:14]), "s1", True),
    ]
    docs = frame(spark, odd + [p[:3] for p in planted])
    bench = spark.createDataFrame([(1, item, "extra"), (2, None, "x"), (3, "too short", "x"), (4, item, "same"), (None, item, "x")], "item_id long, text string, doc_id string")
    got = {r.doc_id: r for r in decontamination.contamination(docs, bench).collect()}
    assert {i for i, r in got.items() if r.contaminated} == {p[0] for p in planted if p[3]} and got[900].coverage == 1.0
    assert got[900]["items"] == [1, 4] and got[900].coverage == 1.0 and got[901].best_item == 1
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    monkeypatch.setattr(decontamination, "CHUNK_BYTES", 10)  # a chunk an item
    again = {r.doc_id: r for r in decontamination.contamination(docs, bench).collect()}
    assert all(again[i].contaminated == r.contaminated and again[i]["items"] == r["items"] and again[i].coverage == r.coverage for i, r in got.items() if i is not None)
    assert decontamination.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontamination.contamination(empty(spark), bench).count() == 0


def test_decontamination_finds_short_items_and_items_without_an_id(spark, monkeypatch):
    r = random.Random(21)
    vocab = [f"v{k}" for k in range(12)]
    items = [(k, " ".join(r.choice(vocab) for _ in range(n))) for k, n in enumerate([1, 2, 3, 4, 4, 6, 9])] + [(None, "only this one here without any id"), (50, "..."), (51, "")]
    docs = [(k, " ".join(r.choice(vocab) for _ in range(r.randrange(0, 14))), "s") for k in range(120)] + [(200, "so Only this one here without any id", "s"), (201, "nothing of them", "s"), (7, "v1", "s"), (None, "v1 v2", "s")]
    want = []
    for i, t, _ in docs:
        d, over = t.lower().split(), []
        for k, x in items:
            x = re.findall("[^\\W_]+", x.lower())
            if x and brute_tiles(x, d, min(5, len(x))) >= 0.8 * len(x):
                over.append(k)
        want.append((i, bool(over), sorted(k for k in over if k is not None)))
    assert any(a and not k for _, a, k in want) and any(not a for _, a, _ in want)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (32 << 20, 10):
        monkeypatch.setattr(decontamination, "CHUNK_BYTES", size)
        got = [(x.doc_id, x.contaminated, x["items"]) for x in decontamination.contamination(frame(spark, docs), bench).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = decontamination.decontaminate(frame(spark, docs), bench)
    assert sorted((x.doc_id for x in kept.collect()), key=repr) == sorted((i for i, a, _ in want if not a), key=repr)


def test_tiling_of_repeated_words_is_not_quadratic():
    import time

    began = time.time()
    assert decontamination.tiles(np.zeros(2000, np.int64), np.zeros(60_000, np.int64)) == [(0, 0, 2000)]
    a = np.tile(np.arange(7), 300)
    assert sum(n for _, _, n in decontamination.tiles(a, np.tile(np.arange(7), 4000))) == len(a)
    assert time.time() - began < 20


def test_decontamination_chunks_give_the_same_rows(spark, odd, monkeypatch):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    other = " ".join(f"w{k}" for k in range(14))
    docs = frame(spark, odd + [(7, f"so {item}", "s1"), (7, other, "s1"), (7, other, "s1"), (None, item, "s1"), (None, f"{other} {item}", "s2"), (None, item[:40], "s2")])
    bench = spark.createDataFrame([(1, item), (2, other), (3, item + " more")], "item_id long, text string")
    key = lambda r: repr(tuple(r))
    one = sorted(decontamination.contamination(docs, bench).collect(), key=key)
    monkeypatch.setattr(decontamination, "CHUNK_BYTES", 10)  # a chunk an item
    assert sorted(decontamination.contamination(docs, bench).collect(), key=key) == one
    assert len(one) == docs.count() and sum(r.contaminated for r in one if r.doc_id is None) == 2 and sum(r.contaminated for r in one if r.doc_id == 7) == 3


# 2
def test_lm_base_is_exact_and_slices_agree(spark, odd, monkeypatch):
    docs = frame(spark, [x for x in odd if x[0] is not None])
    got = {r.doc_id: r for r in lm_scoring.lm_scores(docs).collect()}
    tokens = [(i, WORD.findall(lower(t)) + [None]) for i, t, _ in odd if i is not None]
    c = collections.Counter(w for i, ws in tokens if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0
    monkeypatch.setattr(lm_scoring, "SLICE_MB", 0)
    again = {r.doc_id: r for r in lm_scoring.lm_scores(docs).collect()}
    assert all(math.isclose(again[i].score, r.score, rel_tol=1e-12) for i, r in got.items())
    assert lm_scoring.lm_scores(empty(spark)).count() == 0


def test_lm_score_against_exact_counts(spark, odd, monkeypatch):
    """The score from the filter is that of exact pair counts, rounded down to powers of two, but for a few false positives."""
    rows = [x for x in odd if x[0] is not None]
    tokens = [(i, WORD.findall(lower(t)) + [None]) for i, t, _ in rows]
    train = [ws for i, ws in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(w for ws in train for w in ws)
    two = collections.Counter((a, b) for ws in train for a, b in zip(["<"] + ws, ws))
    n, v = sum(c.values()), len(c)

    def score(ws):
        out = 0.0
        for a, b in zip(["<"] + ws, ws):
            before = len(train) if a == "<" else c[a]
            seen = 2 ** int(math.log2(two[a, b])) if two[a, b] else 0
            out += math.log10((min(seen, c[b], before) + lm_scoring.PRIOR * (c[b] + 1) / (n + v + 1)) / (before + lm_scoring.PRIOR))
        return out

    want = sorted((i, len(ws), score(ws)) for i, ws in tokens)
    for mb in (160, 0):  # one slice, and as many as there are regions
        monkeypatch.setattr(lm_scoring, "SLICE_MB", mb)
        got = sorted((r.doc_id, r.n_tokens, r.score) for r in lm_scoring.lm_scores(frame(spark, rows)).collect())
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert sum(math.isclose(a[2], b[2], rel_tol=1e-9) for a, b in zip(got, want)) >= 0.9 * len(want)
        assert all(a[2] >= b[2] - 1e-6 for a, b in zip(got, want))


def test_lm_texts_are_read_once_for_all_slices(spark, odd, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SLICE_MB", 0)
    sent = []
    monkeypatch.setattr(lm_scoring, "apply_model", lambda rows, model, run=lm_scoring.apply_model: sent.append(model) or run(rows, model))
    plan = lm_scoring.lm_scores(frame(spark, odd))._jdf.queryExecution().executedPlan().toString()
    assert len(sent[0].filters) > 1 and len(sent[0].counts) > 1
    assert plan.count("MapInArrow") == 1 and "hashpartitioning" not in plan and "Union" not in plan


def test_lm_pairs_are_probed_once_and_no_further_than_their_words(monkeypatch):
    r = np.random.default_rng(2)
    keys = np.unique(r.integers(0, 1 << 63, 3000).astype(np.uint64))
    counts = r.integers(1, 60, len(keys))
    import pyarrow as pa

    low, many = keys & lm_scoring._LOW, np.flatnonzero(counts > 1).astype(np.uint32)
    t = pa.table({"region": pa.array([0], pa.int32()), "hi": [(low >> np.uint64(16)).astype(np.uint32).tobytes()], "lo": [(low & np.uint64(0xFFFF)).astype(np.uint16).tobytes()], "many": [many.tobytes()], "times": [counts[many].astype(np.uint32).tobytes()]})
    bits = lm_scoring._region_filter(t)["bits"][0].as_py()
    held = (np.array([0]), np.array([0]), np.array([8 * len(bits)]), bits)
    at = np.concatenate([np.arange(len(keys)), r.integers(0, len(keys), 20_000)])
    r.shuffle(at)
    most = r.integers(0, 40, len(keys))
    free = np.zeros(len(keys), np.uint8)
    lm_scoring._probe(held, 1, keys, free)
    want = np.minimum(np.where(free > 0, 2.0 ** np.maximum(free.astype(np.int64) - 1, 0), 0.0), most)
    asked = []
    monkeypatch.setattr(lm_scoring, "_probe_some", lambda blob, k, *rest, run=lm_scoring._probe_some: asked.append(k) or run(blob, k, *rest))
    sent = type("Sent", (), {"value": held})()
    got = lm_scoring._seen([sent], 1, keys[at], most[at])
    assert (got == want[at]).all()
    assert sum(map(len, asked)) == int((most > 0).sum())
    level = np.zeros(len(keys), np.uint8)
    lm_scoring._probe(held, 1, keys, level, np.full(len(keys), 3, np.uint8))
    assert (level == np.minimum(free, 3)).all()


def test_lm_filter_reads_back_quantised_counts():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 1 << 63, 4000).astype(np.uint64)) & lm_scoring._LOW
    counts = r.integers(1, 40, len(keys))
    import pyarrow as pa

    many = np.flatnonzero(counts > 1).astype(np.uint32)
    t = pa.table({"region": pa.array([0], pa.int32()), "hi": [(keys >> np.uint64(16)).astype(np.uint32).tobytes()], "lo": [(keys & np.uint64(0xFFFF)).astype(np.uint16).tobytes()], "many": [many.tobytes()], "times": [counts[many].astype(np.uint32).tobytes()]})
    bits = lm_scoring._region_filter(t)["bits"][0].as_py()
    level = np.zeros(len(keys), np.uint8)
    held = (np.array([0]), np.array([0]), np.array([8 * len(bits)]), bits)
    lm_scoring._probe(held, 1, keys, level)
    true = np.floor(np.log2(counts)).astype(int) + 1
    assert (level >= true).all() and (level > true).mean() < 0.02
    other = r.integers(0, 1 << 48, 20_000).astype(np.uint64)
    level = np.zeros(len(other), np.uint8)
    lm_scoring._probe(held, 1, other, level)
    assert (level > 0).mean() < 0.01


# 3
@pytest.mark.parametrize("chunk", [4_000_000, 3])
def test_line_spread(spark, odd, monkeypatch, chunk):
    monkeypatch.setattr(line_dedup, "CHUNK_LINES", chunk)
    r = random.Random(5)
    lines = [f"line {k}" for k in range(40)]
    rows = []
    for i in range(300):
        rows.append((i, "\n".join(r.choice(["", "  ", f"own {i}"]) if r.random() < 0.3 else " " * r.randrange(2) + lines[min(39, int(r.expovariate(0.12)))] for _ in range(8)), f"site{r.randrange(14)}" if r.random() < 0.9 else None))
    rows += odd
    sites = collections.defaultdict(set)
    for i, t, s in rows:
        for x in (t or "").split("\n"):
            if x.strip(" \t\r") and s is not None:
                sites[x.strip(" \t\r")].add(s)
    gone = {x for x, s in sites.items() if len(s) >= line_dedup.MIN_SITES}
    assert 3 < len(gone) < 40
    want = []
    for i, t, s in rows:
        ls = [] if t is None else t.split("\n")
        kept = [x for x in ls if x.strip(" \t\r") not in gone]
        want.append((i, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    key = lambda x: repr(x)
    assert sorted(rows_of(line_dedup.line_report(frame(spark, rows))), key=key) == sorted(want, key=key)
    assert line_dedup.line_report(empty(spark)).count() == 0
    kept = line_dedup.remove_lines(frame(spark, rows))
    assert kept.columns == [*frame(spark, rows).columns, "_removed_lines"]
    clash = frame(spark, rows[:5]).withColumnRenamed("lang", "_removed_lines")
    assert line_dedup.remove_lines(clash).columns == [*clash.columns, "_removed_lines_"]


# 4
STRICT = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def strict_spans(t):
    out = []
    for k, (kind, pattern) in enumerate(STRICT.items()):
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_pii_strict_spans(spark, odd):
    r = random.Random(2)
    bits = ["a@b", "@", ".", "1", "255", "256", "000", "+", "-", " ", "(", ")", "4851551512582697", "x_y%", "b.co", "😀", "é", "1.2.3.4", "\n", "4111 1111-1111 1111", "[at]", "a.", "9" * 26, "user [at] mail [dot] com", "(415) 555-2671", "call ", "4111.1111.1111.1111"]
    rows = odd + [(1000 + i, "".join(r.choice(bits) for _ in range(r.randrange(25))), None) for i in range(500)]
    rows += [(2000, "1" * 20_000, None), (2001, "a" * 30_000, None), (2002, "1-" * 9000, None), (2003, "1." * 9000, None), (2004, "a@b.c" * 2000, None), (2005, "+1 " * 5000, None)]
    text = {i: t for i, t, _ in rows}
    for q in pii.find_pii(frame(spark, rows)).collect():
        if q.doc_id is None:
            continue
        want = strict_spans(text[q.doc_id])
        assert q.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (q.n_email, q.n_ip, q.n_card, q.n_phone) == tuple(want.count(k) for k in STRICT)
        spans = set(filter(None, q.spans.split(",")))
        assert set(filter(None, want.split(","))) <= spans and len(spans) == q.n_email + q.n_ip + q.n_card + q.n_phone + q.n_added
    assert pii.find_pii(empty(spark)).count() == 0


def brute_pii(texts):
    """Spans by the same model, found with Python's expressions one text at a time."""
    kinds = list(STRICT)
    digits = lambda m: re.sub("[^0-9]", "", m)

    def valid(kind, m):
        if kind == "ip":
            return all(int(x) <= 255 for x in re.split("[^0-9]+", m))
        if kind == "card":
            d = digits(m)
            return 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind != "phone" or 9 <= len(digits(m)) <= 15

    def known(kind, m):
        if kind == "email":
            return re.search("[A-Za-z0-9-]+$", m) is not None and re.search("[A-Za-z0-9-]+$", m)[0].lower() in pii.TOP_DOMAINS
        if kind == "ip":
            return 1 <= int(re.match("[0-9]+", m)[0]) <= 223
        if kind == "card":
            return re.match(pii.CARD_PREFIX, digits(m)) is not None
        return re.match(r"(\+|00)[1-9]", m) is not None if re.match(r"\+|00", m) else re.match("[2-9][0-8][0-9][2-9]", digits(m)) is not None

    found, counts, pooled = {}, collections.Counter(), collections.Counter()
    for i, t in texts.items():
        spans = []
        for strict, patterns in ((True, STRICT), (False, pii.LOOSE)):
            for k, kind in enumerate(kinds):
                last = 0
                for n, m in enumerate(re.finditer(patterns[kind], t)):
                    gap, ok = t[last : m.start()], valid(kind, m[0])
                    lead = "x" if n and not gap else gap[-1:]
                    v2 = 1 if re.search(pii.CONTEXT[kind], gap[-pii.BEFORE :]) else 0 if re.search(pii.COUNTER, gap[-pii.BEFORE :]) else 2
                    key = (k, (int(ok) if strict else 2 if ok else 0), int(known(kind, m[0])), v2, int(not re.search("[A-Za-z0-9]", lead + "|" + t[m.end() : m.end() + 1])), 0 if len(m[0]) < 12 else 1 if len(m[0]) < 18 else 2)
                    spans.append((strict, ok, m.start(), m.end(), key))
                    last = m.end()
        found[i] = spans
        for *_, key in spans:
            counts[key] += 1
            pooled[key[:5]] += 1
    w = pii.train_classifier(dict(counts), pii.estimate(dict(pooled)))
    least, out = pii.levels(dict(counts), w), {}
    for i, spans in found.items():
        base = [(a, k[0], b) for strict, ok, a, b, k in spans if strict and ok]
        more = [(a, k[0], b) for strict, _, a, b, k in spans if not strict and k[1] == 2 and pii.probability(k, w) >= least[k[0]]]
        more = [x for x in more if not any(y[0] < x[2] and x[0] < y[2] for y in base)]
        out[i] = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(base + more)), len(more)
    return out


def test_pii_added_spans(spark):
    r = random.Random(9)
    bits = ["mail bob [at] site [dot] org now", "user @ host . com", "call (415) 555-2671 please", "+1 (826) 555-4081 190.137.223.20", "4111 1111 1111 1111 5500005555555559", "10[.]0[.]0[.]7", "0044 555 555-0199", "order 4111-1111", "isbn 1234567890123", "x@y.de", "8.8.8.8", "a", "the", "4111.1111.1111.1111", "+49 30 1234567", ",", "\n", "(017) 555-7713"]
    texts = {i: r.choice([" ", "", "  "]).join(r.choice(bits) for _ in range(r.randrange(0, 14))) for i in range(400)}
    texts |= {1000: "x@y.de " * 700, 1001: "(415) 555-2671 8.8.8.8, " * 400, 1002: ""}
    want = brute_pii(texts)
    got = {q.doc_id: (q.spans, q.n_added) for q in pii.find_pii(frame(spark, [(i, t, None) for i, t in texts.items()])).collect()}
    assert got == want and sum(n for _, n in want.values()) > 100


def test_pii_is_linear_in_the_spans(spark):
    import time

    took = []
    for n in (200, 4000, 16_000):
        began = time.time()
        q = pii.find_pii(frame(spark, [(1, "ab@cd.ef " * n, "s"), (2, "(415) 555-2671, " * n, "s")])).collect()
        took.append(time.time() - began)
        assert sum(x.n_email for x in q) == n
    assert took[2] < 4 * took[1] + 10


def test_pii_reliabilities_from_votes():
    r = random.Random(4)
    counts = collections.Counter()
    truth = collections.Counter()
    for _ in range(4000):
        z = r.random() < 0.7
        votes = tuple(int(z) if r.random() < acc else int(not z) for acc in (0.95, 0.9, 0.85, 0.9))
        counts[(0, *votes)] += 1
        truth[(0, *votes)] += z
    post = pii.estimate(dict(counts))
    assert all(abs(post[k] - truth[k] / n) < 0.15 for k, n in counts.items() if n > 100)
    assert pii.estimate({}) == {} and len(pii.train_classifier({}, {})) > 0


# 5 and 6
def test_lexicon_against_plain_search():
    r = random.Random(12)
    syllables = ["ba", "du", "ki", "lo", "me"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 5)))
    for _ in range(60):
        entries = {word() + r.choice([" ", ""]): r.choice([1.0, 2.5, 4.0]) for _ in range(6)}
        phrases = tuple(" ".join(word() for _ in range(r.randrange(1, 4))) for _ in range(4))
        lexicon = toxicity.Lexicon(entries, phrases)
        text = " ".join(r.choice([word(), word().upper(), r.choice(list(entries)), r.choice(phrases), "d0_1", "l@k!l"]) for _ in range(30))
        words = [x.decode() for x in toxicity._WORD.findall(toxicity.fold(text))]
        spared = set()
        for p in phrases:
            q = [x.decode() for x in toxicity._WORD.findall(toxicity.fold(p))]
            spared |= {i + k for i in range(len(words) - len(q) + 1) if q and words[i : i + len(q)] == q for k in range(len(q))}
        want = []
        for k, x in enumerate(words):
            fits = [v for e, v in entries.items() if (x + " ").startswith(e)]
            if fits and k not in spared:
                want.append(max(fits))
        got, n = lexicon.hits(text)
        assert sorted(got) == sorted(want) and n == len(words)


def test_folding():
    assert toxicity.fold("IDI0T") == toxicity.fold("іdіоt") == toxicity.fold("id!ot") == toxicity.fold("ⅰｄiot") == b"idiot"
    assert toxicity.fold("wait! what? 5$ a|b") != toxicity.fold("waiti what? 5$ a|b")


def test_classifiers_on_very_long_texts(spark, labels, odd):
    rows = [*odd, (800, "idiot " * 400_000, "s"), (801, "z" * 3_000_000, "s"), (802, "# " * 900_000, "s")]
    for scores in (toxicity.toxicity_scores, quality.quality_scores):
        got = {x.doc_id: x.score for x in scores(frame(spark, rows), labels).collect()}
        assert all(0 <= got[i] <= 1 for i in (800, 801, 802))


def test_quality_features_and_ranking_against_definitions():
    import pyarrow as pa

    texts = ["The river, the RIVER runs 12 times!\nThe river runs", "", None, "### $$$ ###", "a a a a", "naïve Ünïcode – text"]
    x = quality.features(pa.array(texts, pa.string()))
    assert x.shape == (len(texts), quality.N_FEATURES) and x.min() >= 0 and x.max() <= 1 and (x[1] == x[2]).all()
    bins = lambda v, edges: [min(1, max(0, (v - a) / (b - a))) for a, b in zip(edges[:-1], edges[1:])]
    for t, row in zip(texts, x):
        t = t or ""
        raw, ws = t.encode(), WORD.findall(lower(t))
        black = max(1, sum(c not in (9, 10, 11, 12, 13, 32) for c in raw))
        symbols = sum(chr(c) in "!#$%&*+/<=>@[\\]^_`{|}~" for c in raw) / black
        letters = max(1, sum(65 <= c <= 90 or 97 <= c <= 122 or c > 127 for c in raw))
        upper = sum(65 <= c <= 90 for c in raw) / letters
        n = max(1, len(ws))
        want = bins(symbols, (0, 0.01, 0.05, 0.15, 0.4)) + bins(upper, (0, 0.05, 0.15, 0.5, 1)) + bins(sum(not re.search("[0-9a-z]|[^\\x00-\\x7f]", w) for w in ws) / n, (0, 0.02, 0.1, 0.3))
        want += bins(sum(len(w.encode()) for w in ws) / n, (0, 3.5, 5, 7, 12)) + bins(sum(len(w.encode()) <= 4 for w in ws) / n, (0, 0.15, 0.35, 0.6)) + bins(len(set(ws)) / n, (0, 0.2, 0.5, 0.8, 1))
        want += bins(sum(a == b for a, b in zip(ws, ws[1:])) / n, (0, 0.02, 0.1, 0.5)) + bins((max(0, len(ws) - 1) - len(set(zip(ws, ws[1:])))) / n, (0, 0.05, 0.2, 0.6))
        want += bins(sum(48 <= c <= 57 for c in raw) / black, (0, 0.02, 0.2)) + bins(math.log1p(n / (t.count("\n") + 1)), (0, 3, 6))[:1]
        assert np.allclose(row, want)
    r = np.random.default_rng(2)
    good, bad = r.random((300, 4)) + [0.3, 0, 0, -0.2], r.random((200, 4))
    w = quality.bradley_terry(good, bad)
    rng = np.random.default_rng(1)
    d = good[rng.integers(len(good), size=quality.PAIRS)] - bad[rng.integers(len(bad), size=quality.PAIRS)]
    loss = lambda v: np.log1p(np.exp(-(d @ v))).mean() + quality.L2 / 2 * v @ v
    assert all(loss(w) <= loss(w + e) + 1e-12 for e in 1e-3 * np.concatenate([np.eye(4), -np.eye(4)]))


def test_quality_scores_follow_the_fit(spark, odd, labels):
    import pyarrow as pa

    model = quality.fit(frame(spark, odd), labels)
    got = {x.doc_id: x for x in quality.quality_scores(frame(spark, odd), labels).collect() if x.doc_id is not None}
    for i, t, _ in odd:
        if i is not None:
            z = (quality.features(pa.array([t], pa.string()))[0] @ model["w"] - model["cut"]) / model["scale"]
            assert math.isclose(got[i].score, 1 / (1 + math.exp(-min(50, max(-50, z)))), rel_tol=1e-6, abs_tol=1e-12) and got[i].predicted == (got[i].score >= 0.5)


def test_toxicity(spark):
    r = random.Random(6)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "te", "ru") for b in ("na", "so", "pi", "da", "ve", "gu")]
    bad = ["idiot", "moron", "scumbag"]
    rows, marks = [], []
    for i in range(800):
        w = [r.choice(vocab) for _ in range(r.randrange(5, 60))]
        toxic = r.random() < 0.3
        if toxic:
            w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((i, " ".join(w), "s"))
        marks.append((i, int(toxic)))
    docs = frame(spark, [*rows, (900, None, None), (901, "", "s"), (902, "zeta IDI0T omega", "s"), (903, "mina іdіоt lona", "s"), (904, "the idiotic word", "s")])
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity_scores(docs, labels).collect()}
    y = dict(marks)
    out = [i for i in y if got[i].held_out]
    assert len(out) > 100 and all(got[i].predicted == y[i] for i in out)
    assert got[902].predicted == got[903].predicted == 1 and got[900].predicted == got[901].predicted == 0
    spared = {x.doc_id: x for x in toxicity.toxicity_scores(docs, labels, exceptions=("zeta idiot omega",)).collect()}
    assert spared[902].predicted == 0 and all(spared[i].predicted == y[i] for i in out)
    assert all(0 <= x.score <= 1 for x in got.values())


def test_toxicity_query_spares_harmless_phrases(spark, tmp_path):
    r = random.Random(16)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "te", "ru") for b in ("na", "so", "pi", "da", "ve", "gu")]
    rows, marks, harmless = [], [], set()
    for i in range(700):
        w = [r.choice(vocab) for _ in range(r.randrange(5, 60))]
        kind = r.choice(["toxic", "plain", "plain", "plain", "plain"]) if i % 20 else "harmless"
        at = r.randrange(len(w))
        w[at:at] = {"toxic": ["idiot"], "harmless": ["village", "idiot", "theatre"], "plain": []}[kind]
        harmless |= {i} if kind == "harmless" else set()
        rows.append((i, " ".join(w), "s"))
        marks.append((i, 1, int(kind == "toxic")))
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {x.doc_id: x for x in toxicity.op5_lexicon_toxicity(spark, str(tmp_path)).collect()}
    y = {i: t for i, _, t in marks}
    out = [i for i in y if got[i].held_out]
    assert len(harmless & set(out)) >= 5 and all(got[i].predicted == y[i] for i in out)


def test_toxicity_exceptions_need_varied_contexts(spark):
    rows = [(i, f"aaa{chr(97 + i)} village idiot theatre bbb{chr(97 + i)}", 0) for i in range(12)] + [(20 + i, f"one same idiot text {chr(97 + i)}", 0) for i in range(12)] + [(40 + i, f"ccc{chr(97 + i)} plain idiot", 1) for i in range(6)]
    found = toxicity.learn_exceptions(spark.createDataFrame(rows, "doc_id long, text string, y int"), {"idiot ": 4.0})
    assert found and all("idiot" in p for p in found) and any(p in "village idiot theatre" for p in found) and not any("plain" in p or p == "idiot" for p in found)


def test_quality(spark):
    r = random.Random(7)
    rows, marks = [], []
    for i in range(600):
        w = [r.choice(["the", "river", "runs", "over", "stone", "and", "sand", "while", "birds", "sing", "softly"]) for _ in range(r.randrange(20, 80))]
        good = r.random() < 0.8
        t = " ".join(w) if good else r.choice([" ".join(x + "###" for x in w), " ".join(w).upper() + "!!", " ".join([w[0]] * len(w))])
        rows.append((i, t, "s"))
        marks.append((i, int(good)))
    docs = frame(spark, rows + [(900, None, None), (901, "", "s")])
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    got = {x.doc_id: x for x in quality.quality_scores(docs, labels).collect()}
    y = dict(marks)
    out = [i for i in y if got[i].held_out]
    assert sum(got[i].predicted == y[i] for i in out) >= 0.99 * len(out) and 0 <= got[900].score <= 1
    kept = quality.quality_filter(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, x in got.items() if x.predicted)


def test_quality_threshold_covers_all_training_rows(spark):
    r = random.Random(17)
    rows, marks = [], []
    for i in range(900):
        good = r.random() < 0.7
        w = [r.choice(["the", "River", "runs", "over", "stone", "and", "12", "while"]) + r.choice(["", "", "", "#" * (1 if good else 3), "!"]) for _ in range(r.randrange(10, 40))]
        rows.append((i, " ".join(w), "s"))
        marks.append((i, int(good)))
    model = quality.fit(frame(spark, [*rows, (5, rows[6][1], "s"), (None, "x", "s")]), spark.createDataFrame([*marks, (9999, 0)], "doc_id long, quality int"), per_class=40)
    import pyarrow as pa

    train = [(t, marks[i][1]) for i, t, _ in [*rows, (5, rows[6][1], "s")] if zlib.crc32(str(i).encode()) % quality.MODULUS != quality.REMAINDER]
    s = np.sort(quality.features(pa.array([t for t, _ in train], pa.string())) @ model["w"])
    n, bad = len(s), sum(1 - y for _, y in train) / len(train)
    ks = range(max(0, math.ceil((bad - quality.SLACK) * n) - 1), min(n - 2, math.ceil((bad + quality.SLACK) * n) - 1) + 1)
    k = max(ks, key=lambda k: (s[k + 1] - s[k], -k))
    assert math.isclose(model["cut"], (s[k] + s[k + 1]) / 2, rel_tol=1e-9)


@pytest.mark.parametrize("scores", [toxicity.toxicity_scores, quality.quality_scores])
def test_classifiers_on_odd_rows(spark, odd, labels, scores):
    docs = frame(spark, odd)
    got = rows_of(scores(docs, labels))
    assert len(got) == len(odd) and all(0 <= s <= 1 and p in (0, 1) and h is not None for _, h, s, p in got)
    assert scores(empty(spark), labels).count() == 0
    assert scores(docs, labels.limit(0)).count() == len(odd)


# 7
@pytest.mark.parametrize("hot,most", [(1000, 1 << 28), (1, 1 << 28), (1000, 1 << 18)])
def test_exact_dedup(spark, odd, monkeypatch, hot, most):
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", hot)
    monkeypatch.setattr(exact_dedup, "MAX_SLOTS", most)  # the last: a few slices
    monkeypatch.setattr(exact_dedup, "SLOTS_PER_ROW", 4000 if most == 1 << 18 else 16)
    groups = collections.defaultdict(list)
    for i, t, _ in odd:
        groups[t or ""].append(i)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert sorted(rows_of(exact_dedup.exact_dedup(frame(spark, odd))), key=repr) == sorted(want, key=repr)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


# 8
def brute_links(rows, n=4, num=85, den=100):
    sets = {}
    for i, t, _ in rows:
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root, links, where = {i: i for i in sets}, collections.Counter(), collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j, c in collections.Counter(j for g in s for j in where[g]).items():
            if j != i and den * c >= num * (len(s) + len(sets[j]) - c):
                links[i] += 1
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: (len(s), top(i), links[i]) for i, s in sets.items()}


def near_copies(seed=5):
    r = random.Random(seed)
    vocab, rows = [f"w{i}" for i in range(2000)], []
    for _ in range(40):
        w = [r.choice(vocab) for _ in range(r.choice([3, 5, 8, 20, 40, 60, 200, 500]))]
        for _ in range(r.choice([1, 2, 5, 25])):
            v = list(w)
            for _ in range(r.randrange(1 + max(1, len(w) // 25))):
                v[r.randrange(len(v))] = r.choice(vocab)
            rows.append((len(rows), " ".join(v[: len(v) - (r.random() < 0.3) * max(1, len(v) // 40)]), "s"))
    big = [r.choice(vocab) for _ in range(90)]
    for _ in range(220):
        v = list(big)
        for _ in range(r.randrange(5)):
            v[r.randrange(len(v))] = r.choice(vocab)
        rows.append((len(rows), " ".join(v), "s"))
    rows += [(len(rows) + k, t, None) for k, t in enumerate([None, "", " \n", "a", "A", "a b", "x " * 20_000])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("region,leaf", [(6000, 200), (256, 24), (60, 20)])
def test_jaccard_join(spark, monkeypatch, region, leaf):
    monkeypatch.setattr(jaccard_join, "REGION_SETS", region)
    monkeypatch.setattr(jaccard_join, "HOT", 48 if region < 6000 else 10_000)
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    rows = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.jaccard_components(frame(spark, rows)).collect()}
    assert got == brute_links(rows)


def test_jaccard_join_recursion_is_exact(monkeypatch):
    """Cells that do separate: far clusters of near copies."""
    monkeypatch.setattr(jaccard_join, "LEAF", 10)
    r = np.random.default_rng(3)
    sets = []
    for c in range(12):
        base = r.integers(0, 1 << 62, 60).astype(np.uint64)
        for _ in range(15):
            s = base.copy()
            s[r.integers(0, 60, r.integers(0, 8))] = r.integers(0, 1 << 62, 1).astype(np.uint64)
            sets.append(np.unique(s))
    rule, n = jaccard_join.Rule(), len(sets)
    want = {(i, j) for i in range(n) for j in range(n) if i != j and rule.linked(np.array(c := len(np.intersect1d(sets[i], sets[j]))), len(sets[i]), len(sets[j]))}
    got = set()
    jaccard_join.Cells(rule, sets).join(np.arange(n), np.arange(0), lambda x, ys: got.update((x, int(y)) for y in ys))
    assert got == want


@pytest.mark.parametrize("which", ["documents", "near copies"])
def test_jaccard_join_makes_regions_and_cells(spark, monkeypatch, which):
    """Homes and guests, windows around the homes' union, Voronoi cells of documents: on the tables' documents, and on many near copies."""
    import os

    import pyarrow as pa

    d = "/root/testdata/sf0.1"
    if not os.path.isdir(d):
        pytest.skip("no tables here")
    rule = jaccard_join.Rule()
    texts = [r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("text").distinct().collect()] if which == "documents" else sorted({t for _, t, _ in near_copies() if t and t != "A"})
    ends, flat = jaccard_join.shingle_sets(pa.array(texts, pa.string()), rule.n)
    size, keys = np.diff(ends), jaccard_join.set_keys(ends, flat)
    node = jaccard_join._node(keys)
    at = {int(x): k for k, x in enumerate(node)}
    who, sig, often = jaccard_join.signatures(rule, size, flat, np.zeros(jaccard_join.SKETCH_SLOTS // 8, np.uint8))
    assert not often.any() and (np.bincount(who, minlength=len(size)) == np.minimum(rule.prefix(size), size)).all()
    _, cell, count = np.unique(sig, return_inverse=True, return_counts=True)
    met = spark.createDataFrame([(int(s), int(node[w]), False) for s, w in zip(sig.view(np.int64)[count[cell] > 1], who[count[cell] > 1])], "sig long, node long, often boolean")
    reps = spark.createDataFrame([(int(x), int(n), bytearray(p)) for x, n, p in zip(node, size, jaccard_join.profiles(size, flat))], "node long, n_shingles long, profile binary")
    got = jaccard_join.regions(rule, met, reps).collect()
    homes = {at[r.node]: r.region for r in got if r.home}
    there = {(at[r.node], r.region) for r in got}
    assert len(set(homes.values())) > (200 if which == "documents" else 5) and len(there) == len(got)
    assert which == "documents" or sum(not r.home for r in got) > 10
    some = sorted(homes)
    sets = [flat[ends[x] : ends[x + 1]] for x in some]

    def links(leaf):
        monkeypatch.setattr(jaccard_join, "LEAF", leaf)
        out = set()
        made = jaccard_join.Cells(rule, sets).join(np.arange(len(sets)), np.arange(0), lambda x, ys: out.update((some[x], some[y]) for y in ys))
        return made, out

    none, plain = links(1 << 40)
    made, found = links(jaccard_join.MAX_PIVOTS)
    assert none == 0 and found == plain and len(plain) > 20
    union = collections.defaultdict(set)
    for x, region in homes.items():
        union[region] |= set(flat[ends[x] : ends[x + 1]].tolist())
    for a, b in plain:  # each partner is in the other's home region, within the link distance of its pivot
        assert (b, homes[a]) in there and 100 * len(union[homes[a]].intersection(flat[ends[b] : ends[b + 1]].tolist())) >= 85 * size[b]
    # clusters of documents that do part: the most linked ones and a few of their neighbours
    near = [x for x, _ in collections.Counter(a for a, _ in plain).most_common(60)]
    cells, out = jaccard_join.Cells(rule, [flat[ends[x] : ends[x + 1]] for x in near]), set()
    made = cells.join(np.arange(len(near)), np.arange(0), lambda x, ys: out.update((near[x], near[y]) for y in ys))
    assert (made > 1 or which != "documents") and out == {(a, b) for a, b in plain if a in near and b in near}


def test_jaccard_join_cost_does_not_follow_the_buckets(spark):
    """A signature takes as many bytes in 12 buckets as in 734."""
    import pyarrow as pa

    rows = [t for _, t, _ in near_copies() if t]
    batch = pa.RecordBatch.from_arrays([pa.array(rows * 1)], ["text"])

    class Hot:
        value = bytes(jaccard_join.SKETCH_SLOTS // 8)

    def size(buckets):
        out = list(jaccard_join._signature_blocks(jaccard_join.Rule(), buckets, Hot)(iter([batch])))
        return sum(len(x) for b in out for c in ("sig", "node", "code") for x in b.column(c).to_pylist())

    assert size(12) == size(734)


def test_one_of_each_judges_rows_by_their_own_text(spark):
    r = random.Random(31)
    words = [f"w{k}" for k in range(400)]
    a, b, c = (" ".join(r.choice(words) for _ in range(60)) for _ in range(3))
    rows = [(1, a, "s1"), (5, a + " end", "s2"), (5, b, "s3"), (5, b, "s3"), (6, b, "s4"), (None, c, "s5"), (None, c, "s5"), (None, None, "s6"), (None, "", "s6"), (9, "", "s"), (10, None, "s"), (10, None, "s")]
    kept = jaccard_join.one_of_each(frame(spark, rows), rule=jaccard_join.Rule(5, 80, 100))
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=repr) == sorted([(1, a), (5, b), (None, c), (None, None), (None, ""), (9, ""), (10, None)], key=repr)
    assert jaccard_join.one_of_each(empty(spark)).count() == 0


def test_jaccard_join_odd_rows(spark, odd):
    got = jaccard_join.jaccard_components(frame(spark, odd)).collect()
    assert len(got) == len(odd) and all((r.component_id is None) == (r.doc_id is None) for r in got)
    assert jaccard_join.jaccard_components(empty(spark)).count() == 0
    docs = frame(spark, odd)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert {r.doc_id for r in kept.collect()} == {i for i, c in ids.items() if i == c} | {None}


# 9
def brute_mix(spark, docs, seed, shards):
    """Times and shards of each row: blocks, their order, the cut block and the tree, one source at a time. Only hashes are Spark's."""
    from pyspark.sql import functions as F

    h = lambda *x: F.xxhash64(*x)
    rows = docs.select("doc_id", "source", "text", h(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")), F.lit(seed)).alias("mark"))
    rows = [r.asDict() for r in rows.withColumn("place", h("mark")).withColumn("turn", h("mark", F.lit(seed + "/row"))).collect()]
    sources = collections.defaultdict(list)
    for r in rows:
        r["size"] = len(WORD.findall(r["text"] or ""))
        sources[r["source"]].append(r)
    sizes = {s: sum(r["size"] for r in x) for s, x in sources.items()}
    goal, counts, blocks = mixing.targets(sizes), {}, {}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    for s in order:
        n_blocks = min(mixing.MAX_BLOCKS, max(1, -(-sizes[s] // mixing.BLOCK_WORDS)))
        whole = int(min(3, goal[s] // sizes[s])) if sizes[s] else 0
        rest = goal[s] - whole * sizes[s]
        in_block = collections.defaultdict(list)
        for r in sources[s]:
            in_block[r["place"] % n_blocks].append(r)
        turns = {r.b: r.t for r in spark.createDataFrame([(b,) for b in in_block], "b long").select("b", h("b", F.lit(seed + "/permute")).alias("t")).collect()}
        upto, blocks[s] = 0, []
        for b in sorted(in_block, key=lambda b: (turns[b], b)):
            words = sum(r["size"] for r in in_block[b])
            extra, cut = upto + words <= rest, upto + words > rest and upto < rest
            need = rest - upto
            upto += words
            pool = collections.defaultdict(int)
            for r in in_block[b]:
                pool[r["mark"]] += r["size"]
                r["times"] = whole + extra
            if cut:
                turn, drawn = {r["mark"]: r["turn"] for r in in_block[b]}, set()
                for _ in range(mixing.FILL_ROUNDS):
                    room, sum_ = need, 0
                    for m in sorted(pool, key=lambda m: (turn[m], m)):
                        if m not in drawn and pool[m] <= room:
                            sum_ += pool[m]
                            if sum_ <= room:
                                drawn.add(m)
                                need -= pool[m]
                for r in in_block[b]:
                    r["times"] += r["mark"] in drawn
            blocks[s].append((in_block[b], whole + extra + cut))
        counts[s] = sum(n for _, n in blocks[s])
    tree = mixing.splitting_tree(counts, shards, random.Random(seed))
    for s in order:
        ends, first = np.cumsum([part[s] for part in tree]), 0
        for held, n in blocks[s]:
            own = [int((ends <= first + k).sum()) for k in range(n)]
            first += n
            for r in held:
                r["shards"] = own[: r["times"]]
    return rows


def test_mixing(spark, odd, monkeypatch):
    r = random.Random(8)
    rows = [(i, "w " * r.randrange(1, 200), f"s{min(4, int(r.expovariate(0.7)))}" if r.random() < 0.97 else None) for i in range(1500)]
    rows += [rows[3], rows[3], (None, "no id " * 9, "s1"), (None, "other " * 9, "s1"), (3000, None, "s2"), (3001, "", None)]
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 2500)
    docs = frame(spark, rows)
    got = mixing.mix(docs).collect()
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    source = {i: s for i, _, s in rows}
    want = mixing.targets(dict(size))
    assert math.isclose(sum(want.values()), sum(size.values()), rel_tol=1e-9) or all(want[s] == 3 * size[s] for s in size)
    brute = brute_mix(spark, docs, mixing.SEED, mixing.SHARDS)
    key = lambda x: repr(x)
    assert sorted(((x.doc_id, x["size"], x.taken, list(x.shards)) for x in got), key=key) == sorted(((x["doc_id"], x["size"], x["size"] * x["times"], x["shards"]) for x in brute), key=key)
    assert any(len(set(x.shards)) > 1 for x in got)
    taken, ranks = collections.Counter(), collections.defaultdict(list)
    for x in got:
        s = source[x.doc_id] if x.doc_id is not None else "s1"
        assert x.source_size == size[s] and math.isclose(x.target, want[s]) and x.taken <= 3 * x["size"] and len(x.shards) == len(x.ranks)
        taken[s] += x.taken
        for shard, rank in zip(x.shards, x.ranks):
            ranks[shard].append((rank, x.doc_id))
    assert all(abs(taken[s] - want[s]) <= 20 + 0.01 * want[s] for s in size)
    assert all(sorted(k for k, _ in v) == list(range(len(v))) for v in ranks.values())
    again = mixing.mix(frame(spark, rows, 7)).drop("ranks")  # equal rows may change places
    assert sorted(rows_of(again), key=key) == sorted((tuple(x)[:-1] for x in got), key=key)
    monkeypatch.setattr(mixing, "CELL_DRAWS", 20)  # many cells
    more = mixing.mix(docs).collect()
    assert sorted((x.doc_id, sorted(x.ranks)) for x in more if x.doc_id is not None and x.doc_id not in (3, rows[3][0])) == sorted((x.doc_id, sorted(x.ranks)) for x in got if x.doc_id is not None and x.doc_id not in (3, rows[3][0]))
    copies = collections.Counter((x.doc_id, x.text) for x in mixing.mixed_rows(docs).collect())
    expected = collections.Counter()
    for x in brute:
        expected[x["doc_id"], x["text"]] += x["times"]
    assert copies == +expected
    for cell in (4_000_000, 500):
        monkeypatch.setattr(mixing, "CELL_WORDS", cell)
        ordered = [[x.doc_id for x in part] for part in mixing.mixed_rows(docs).rdd.glom().collect() if part]
        place = {(s, k): i for s, v in ranks.items() for k, i in v}
        runs = [[i for _, i in sorted(v)] for _, v in sorted(ranks.items())]
        if cell == 4_000_000:  # a cell a shard: the shards' local shuffles, one after the other in their partitions
            flat = [i for part in ordered for i in part]
            for run in runs:
                distinct = [i for i in run if i is not None and run.count(i) == 1]
                at = [k for k in range(len(flat) - len(run) + 1) if [i for i in flat[k : k + len(run)] if i in set(distinct)] == distinct]
                assert at
        assert len(place) == sum(map(len, ordered))
    assert len(rows_of(mixing.mix(frame(spark, odd)))) == len(odd)
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed_rows(empty(spark)).count() == 0 and mixing.mixed_rows(frame(spark, odd)).columns == frame(spark, odd).columns


def test_mixed_rows_with_any_column_names(spark):
    rows = [(i, f"w{i} " * 20, f"s{i % 2}", i, i, i, i, i, i) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mark long, block long, n long, d long, _mix_source long, shard long")
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns and all(tuple(x)[3:] == (x.doc_id,) * 6 for x in out.collect())


def test_targets_stop_at_three_times_and_reshare():
    assert mixing.targets({}) == {}
    t = mixing.targets({"a": 10, "b": 1000, "c": 1000})
    assert t["a"] == 30 and math.isclose(t["b"], 1980 * 2 / 3) and math.isclose(t["c"], 1980 / 3)
    assert mixing.targets({"a": 0, None: 5})[None] == 5


def test_splitting_tree_keeps_quotas():
    rng = random.Random(1)
    counts = {"a": 1000, "b": 37, "c": 1, None: 0}
    parts = mixing.splitting_tree(counts, 16, rng)
    assert all(sum(p[s] for p in parts) == n for s, n in counts.items())
    totals = [sum(p.values()) for p in parts]
    assert max(totals) - min(totals) <= 5
    share = [mixing._hypergeometric(rng, 30, 70, 50) for _ in range(400)]
    assert 14 < sum(share) / 400 < 16 and min(share) >= 0 and max(share) <= 30


# 10
def test_sharding(spark, odd):
    got = sharding.shard(frame(spark, odd)).collect()
    text = {i: t or "" for i, t, _ in odd if i is not None}
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 40)
        if r.doc_id is not None:
            assert r["size"] == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(got) == len(odd)
    assert sharding.shard(empty(spark)).count() == 0
    ids = spark.range(20_000).selectExpr("id AS doc_id", "'x' AS text")
    n = collections.Counter(r.shard for r in sharding.shard(ids).collect())
    assert len(n) == 40 and max(n.values()) < 1.25 * 500
    import xxhash

    def draw(key, j):  # by the hash's definition
        h = xxhash.xxh64_intdigest(j.to_bytes(4, "little"), seed=xxhash.xxh64_intdigest(key.encode(), seed=42))
        return ((h & ((1 << 53) - 1)) + 0.5) / (1 << 53)

    for x in sharding.shard(frame(spark, odd)).collect():
        k = "" if x.doc_id is None else str(x.doc_id)
        assert x.shard == max(range(40), key=lambda j: (draw(k, j), j)) and x.grown_shard == max(range(41), key=lambda j: (draw(k, j), j))
    heavy = [1.0, 3.0, 0.5]
    for x in sharding.sharded_rows(spark.range(200).selectExpr("id AS doc_id"), weights=heavy).collect():
        assert x.shard == max(range(3), key=lambda j: -heavy[j] / math.log(draw(str(x.doc_id), j)))
    many = spark.range(5000).selectExpr("CAST(NULL AS long) AS doc_id", "concat('t', id) AS text")
    slots = sorted(x.slot for x in sharding.shard(many).collect())
    assert slots == list(range(5000))  # one shard, numbered in several cells
    weights = [1.0] * 39 + [5.0]
    n = collections.Counter(r.shard for r in sharding.sharded_rows(ids, weights=weights).collect())
    assert 0.8 < n[39] / (20_000 * 5 / 44) < 1.2
