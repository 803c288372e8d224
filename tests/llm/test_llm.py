"""Operators of the training-data subpackage against plain versions, on texts with every odd case."""

import collections
import hashlib
import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk int, kind string, rep long, removed int, score double"


def texts():
    rng = random.Random(3)
    words = ["the", "er", "thion", "of", "reth", "île", "naïve", "日本", "x"]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))
    base, out = prose(120), [None, "", " \t\n", "a", "A b", "a b", "\x00", "aaaa" * 300, prose(4000)]
    out += [base, base, base.upper(), base + " tail", "head " + base, prose(30) + base[100:400] + prose(20)]
    for _ in range(12):  # near copies that need not be near each other
        w = base.split()
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = prose(1)
        out.append(" ".join(w))
    return out + [prose(rng.randint(1, 200)) for _ in range(25)]


def documents(spark, rows=None):
    found = [(i, t) for i, t in enumerate(texts())] if rows is None else rows
    found = found + ([found[9], (None, found[12][1]), (None, None)] if rows is None else [])
    return spark.createDataFrame([(i, t, "en", None, 1, 7, "k", 8, 9, 0.5) for i, t in found], SCHEMA), found


def words(text):
    return (text or "").encode().lower().split()


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=str)


def test_neardup_matches_all_pairs(spark):
    from strandloom.llm.neardup import near_duplicates

    df, rows = documents(spark)
    for width, threshold in ((3, 0.85), (5, 0.8), (1, 0.5)):
        sets = {}
        for i, t in rows:
            w = words(t)
            sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
        part = {i: i for i in sets if i is not None}
        for _ in part:
            for a in part:
                for b in part:
                    both = len(sets[a] & sets[b])
                    if both and 100 * both >= round(100 * threshold) * len(sets[a] | sets[b]):
                        part[a] = part[b] = min(part[a], part[b])
        expected = sorted(((i, len(sets[i]), part.get(i), None if i is None else i == part[i]) for i, _ in rows if i is not None), key=str)
        found = [x for x in got(near_duplicates(df, width, threshold), "doc_id", "n_shingles", "component_id", "kept") if x[0] is not None]
        assert found == expected
    assert near_duplicates(df.limit(0)).count() == 0


def test_neardup_links_all_texts_of_an_id(spark):
    from strandloom.llm.neardup import near_duplicates

    text = lambda k: " ".join(f"w{k}x{j}" for j in range(80))
    rows = [(1, text(1)), (1, text(2)), (2, text(1) + " a"), (3, text(2) + " b")]  # two texts under the smallest id
    rows += [(10, text(3)), (13, text(3)), (11, text(4)), (13, text(4)), (14, text(4) + " c"), (20, text(5)), (20, text(5)), (21, None), (21, text(5))]
    df, _ = documents(spark, rows)
    found = set(got(near_duplicates(df, 3, 0.85), "doc_id", "component_id"))
    assert found == {(1, 1), (2, 1), (3, 1), (10, 10), (13, 10), (11, 10), (14, 10), (20, 20), (21, 20)}


def test_neardup_hot_groups_are_dealt(spark, monkeypatch):
    from strandloom.llm import neardup as N

    rng, base = random.Random(4), [f"w{j}" for j in range(400)]
    rows = []
    for i in range(60):  # copies of one text, and copies with one change each
        words_ = list(base)
        if i % 3:
            words_[rng.randrange(400)] = f"v{i}"
        rows.append((i, " ".join(words_)))
    rows += [(100 + i, " ".join(f"u{i}x{j}" for j in range(50))) for i in range(5)]
    df, _ = documents(spark, rows)
    whole = got(N.near_duplicates(df, 3, 0.85), "doc_id", "component_id")
    assert whole == sorted([(i, 0) for i in range(60)] + [(100 + i, 100 + i) for i in range(5)], key=str)
    monkeypatch.setattr(N, "HOT", 3)
    monkeypatch.setattr(N, "TILE", 4)
    assert got(N.near_duplicates(df, 3, 0.85), "doc_id", "component_id") == whole


def test_sketches_estimate_similarity():
    from strandloom.llm import neardup as N

    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 62, 3000, dtype=np.int64).astype(np.uint64)
    a, b = x[:2000], x[500:2500]
    sketch = N.setsketch(np.concatenate([a, b, x]), np.array([2000, 2000, 3000]))
    found = N.estimate(sketch[:1], sketch[1:2], np.array([2000.0]), np.array([2000.0]))[0]
    assert abs(found - 1500 / 2500) < 0.15
    union = N.setsketch(np.unique(np.concatenate([a, b])), np.array([2500]))
    assert (np.maximum(sketch[0], sketch[1]) == union[0]).all()


def plain_spans(rows, length):
    seen, out = set(), {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        data, covered = (t or "").encode(), set()
        for p in range(len(data) - length + 1):
            if data[p : p + length] in seen:
                covered.update(range(p, p + length))
            seen.add(data[p : p + length])
        kept = bytes(x for k, x in enumerate(data) if k not in covered)
        out.setdefault(i, []).append((i, len(data), len(covered), sum(k - 1 not in covered for k in covered), hashlib.sha256(kept).hexdigest()))
    return sorted((x for v in out.values() for x in v), key=str)


def test_suffix_matches_every_string(spark):
    from strandloom.llm.suffix import digests, repeated_spans, without_spans

    df, rows = documents(spark)
    for length in (100, 40):
        found = [x for x in got(digests(repeated_spans(df, length)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") if x[0] is not None]
        assert found == plain_spans(rows, length)
    left = without_spans(repeated_spans(df, 100))
    assert left.columns == [c for c in df.columns if c != "removed"] and left.count() == len(rows)
    assert digests(repeated_spans(df.limit(0))).count() == 0


def test_multikey_sort_and_reach():
    from strandloom.llm import suffix as S

    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 400, dtype=np.uint8)
    text = S._characters(np.concatenate([np.zeros(128, np.uint8), data, np.zeros(128, np.uint8)]))
    at = np.arange(128, 500)
    order, label = S.multikey_sort(text, at, np.zeros(len(at), np.int64), np.array([0, 8, 16]))
    padded = np.concatenate([np.zeros(128, np.uint8), data, np.zeros(128, np.uint8)]).tobytes()
    keys = [padded[p : p + 24] for p in at[order]]
    assert keys == sorted(keys) and (np.diff(label) > 0).tolist() == [a != b for a, b in zip(keys, keys[1:], strict=False)]
    i, j = rng.integers(160, 400, 300), rng.integers(160, 400, 300)
    for back in (False, True):
        found = S._reach(text, i, j, np.full(300, 60), back)
        for a, b, n in zip(i, j, found, strict=True):
            m = 0
            while m < 60 and (padded[a - m - 1] == padded[b - m - 1] if back else padded[a + m] == padded[b + m]):
                m += 1
            assert m == n


def test_lm_matches_plain_model(spark):
    from strandloom.llm.lm import every_seventh, lm_scores

    df, rows = documents(spark)
    df, rows = df.filter("doc_id is not null"), [r for r in rows if r[0] is not None]
    c, pairs, docs = collections.Counter(), collections.Counter(), 0
    for i, t in rows:
        if not every_seventh(i):
            w = [*words(t), None]
            c.update(w)
            pairs.update(zip(["<s>", *w], w, strict=False))
            docs += 1
    n, v = sum(c.values()), len(c)
    uni = lambda x: (c[x] + 1) / (n + v + 1)
    found = lm_scores(df, prior=30.0).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    for i, t in rows:
        w, r = [*words(t), None], by[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (every_seventh(i), len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10(uni(x)) for x in w), rel_tol=1e-9, abs_tol=1e-9)
        p = 0
        for h, x in zip(["<s>", *w], w, strict=False):
            ch = docs if h == "<s>" else c[h]
            p += math.log10((pairs[h, x] + 30 * uni(x)) / (ch + 30))
        assert math.isclose(r["score"], p, rel_tol=1e-3, abs_tol=1e-3)
    assert lm_scores(df.limit(0)).count() == 0
    assert lm_scores(documents(spark)[0]).count() == len(rows) + 2


def test_elias_fano():
    from strandloom.llm.lm import Level, _sequence

    rng = np.random.default_rng(2)
    for values in (np.array([], np.uint64), np.array([5, 5, 9], np.uint64), np.sort(rng.integers(0, 1 << 63, 500, dtype=np.int64).astype(np.uint64)), np.arange(1000, dtype=np.uint64) * np.uint64(3)):
        x = np.concatenate([values, values + np.uint64(1), rng.integers(0, 1 << 63, 50, dtype=np.int64).astype(np.uint64), np.array([0], np.uint64)])
        own = Level(**_sequence("s", values)).sequence("s")
        at, equal = own.successor(x)
        assert (at == np.searchsorted(values, x)).all() and (equal == np.isin(x, values)).all()
        assert (own.get(np.arange(len(values))) == values).all()
        begin = rng.integers(0, len(values) + 1, len(x))
        end = np.minimum(begin + rng.integers(0, 9, len(x)), len(values))
        at, equal = own.successor(x, begin, end)
        want = [b + np.searchsorted(values[b:e], y) for y, b, e in zip(x, begin, end, strict=True)]
        assert at.tolist() == want and equal.tolist() == [w < e and values[w] == y for y, w, e in zip(x, want, end, strict=True)]


def test_packing(spark):
    from strandloom.llm.packing import best_fit_pack, encoder, plan

    df, rows = documents(spark)
    found = best_fit_pack(df, BPE, capacity=64).collect()
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append([*encoder(BPE).exact.encode(t or "", add_special_tokens=False).ids, 0])
    assert sum(r["length"] for r in found) == sum(len(x) for v in ids.values() for x in v)
    for r in found:
        assert any(zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
    bins = collections.defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    lengths = [r["length"] for r in found]
    room = []
    for x in sorted(lengths, reverse=True):  # best-fit decreasing, one by one
        fit = min((r for r in room if r >= x), default=None)
        if fit is None:
            room.append(64 - x)
        else:
            room[room.index(fit)] -= x
    assert len(bins) == len(room) == plan(collections.Counter(lengths), 64)[1]
    assert best_fit_pack(df.limit(0), BPE).count() == 0
    special = "x <|endoftext|> y　  'Twas  \r\n"
    assert encoder(BPE)(special) == encoder(BPE).exact.encode(special, add_special_tokens=False).ids


def test_top_k(spark):
    from strandloom.llm.topk import exact_top_k

    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], "x") for i in range(300)] + [(i, [0.5] * 6, "x") for i in range(300, 420)]
    rows += [(500, None, "x"), (None, [1.0] * 6, "x"), (550, [1.0, None, 2.0], "x"), (600, [float("nan")] * 6, "x"), (650, [float("inf")], "x"), (700, [3.0], "x"), (7, [0.25] * 6, "x"), (750, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block string")
    clean = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in clean:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, x, strict=False)), i) for i, x in clean if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    found = exact_top_k(df, F.col("vec_id") % 50 == 0)
    assert got(found, "query_id", "rank", "vec_id", "score") == sorted(want, key=str)
    assert exact_top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_decontamination_matches_edit_distance(spark):
    from strandloom.llm.decontam import benchmark_matches, plain, without_leaks

    rng = random.Random(6)
    pool = ["the", "er", "thion", "an", "of", "reth", "es"]
    prose = lambda n: " ".join(rng.choice(pool) + rng.choice(pool) for _ in range(n))
    items = [(k, prose(rng.randint(4, 15))) for k in range(12)] + [(50, None), (51, " "), (3, "copy of an item that has the same number")]
    rows = [(0, None), (1, ""), (None, items[0][1])]
    for k in range(60):
        x = list(items[k % 12][1])
        for _ in range(rng.randint(0, int(0.14 * len(x)))):
            x[rng.randrange(len(x))] = rng.choice(["", "z", "er"])
        rows.append((k + 2, prose(20) + " " + "".join(x).upper() + "\n" + prose(9)))

    def distance(p, t):
        before = [0] * (len(t) + 1)
        for i, c in enumerate(p):
            now = [i + 1]
            for j, d in enumerate(t):
                now.append(min(before[j] + (c != d), before[j + 1] + 1, now[j] + 1))
            before = now
        return min(before)

    want = sorted(((i, k, d) for i, t in rows for k, x in items if plain(x) and plain(t) and (d := distance(plain(x), plain(t))) <= int(0.1 * len(plain(x)))), key=str)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, distance int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (4 << 20, 300):
        assert got(benchmark_matches(docs, bench, part_bytes=size), "doc_id", "item_id", "distance") == want
        left = without_leaks(docs, bench, part_bytes=size)
        hit = {r[0] for r in want}
        assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [i for i, _ in rows if i is not None and i not in hit]
    assert benchmark_matches(docs.limit(0), bench).count() == 0 and benchmark_matches(docs, bench.limit(0)).count() == 0


def test_warc_round_trip(spark):
    from strandloom.llm.warc import archive, digest, read_captures, surt

    rows = [(5, "http://a.example.com/x y?q=1", "<p>é</p>"), (3, "http://b.org", "<p>é</p>"), (9, None, None), (8, "http://[bad", ""), (None, "http://b.org", "<p>é</p>"), (3, "http://b.org", "<p>é</p>"), (11, "https://c.d:444/\r\nx", "z\r\n\r\n" * 2000)]
    df = spark.createDataFrame([(*r, "o", 1) for r in rows], "page_id long, url string, html string, offset string, first int")
    directory, index, archives = archive(df)
    found = read_captures(directory, index, archives)
    want = []
    for i, _, h in rows:
        payload = (h or "").encode()
        first = min((j for j, _, x in rows if j is not None and (x or "") == (h or "")), default=None)
        revisit = i is not None and i != first
        want.append((i, len(payload), digest(payload), "revisit" if revisit else "response", first if revisit else None))
    assert got(found, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=str)
    assert {bytes(r["payload"]) for r in found.filter("payload is not null").collect()} == {(h or "").encode() for _, _, h in rows}
    assert surt("http://a.example.com:80/x?y") == "com,example,a)/x?y"
    hit = read_captures(directory, index, archives, [surt("http://b.org")])
    assert sorted(map(str, (r["page_id"] for r in hit.collect()))) == ["3", "3", "None"]
    from strandloom.llm.warc import page_keys

    asked = read_captures(directory, index, archives, page_keys(df), slice_blocks=2)  # many slices of the directory
    assert got(asked, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=str)
    assert read_captures(directory, index, archives, ["no,such)/"]).count() == 0
    directory, index, archives = archive(df.limit(0))
    assert read_captures(directory, index, archives, page_keys(df)).count() == 0
    assert read_captures(directory, index, archives).count() == 0


def test_words_that_polynomials_confuse():
    import pyarrow as pa

    from strandloom.llm import text as T

    row = "a"
    for _ in range(12):
        row += row.translate(str.maketrans("ab", "ba"))
        other = row.translate(str.maketrans("ab", "ba"))
        h, counts = T.word_hashes(*T.flat(pa.array([f"{row} {other} {row.upper()}", None, ""])))
        assert h[0] != h[1] and h[0] == h[2] and counts.tolist() == [3, 0, 0]


def test_chat_round_trip(spark):
    from strandloom.llm.chat import chat_windows, escape, parse_window, read_back, unescape

    for x in ("<|im_end|>", "<\\|a<\\\\|b", "<", "|", "<<||>>", "\\<|\\"):
        assert unescape(escape(x)) == x and "<|" not in escape(x)
    rng, rows = random.Random(8), []
    for c in [*range(20), None]:
        for t in range(rng.randint(1, 40)):
            role = "system" if t == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "to\nol\\n", None])
            rows.append((c, t, role, rng.choice([None, "", "<|im_end|>\n", "word " * rng.randint(1, 80)])))
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "conv_id long, turn long, role string, text string, window string, loss int")
    by = collections.defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        by[c].append((r or "", x or ""))
    windows = chat_windows(df, BPE, budget=120, history=40)
    want = sorted(((c, len(v), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in v).encode()).hexdigest(), sum(len(x) for r, x in v if r == "assistant"), hashlib.sha256("".join(x for r, x in v if r == "assistant").encode()).hexdigest()) for c, v in by.items()), key=str)
    assert got(read_back(windows), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == want
    count = lambda x: len(Tokenizer.from_file(BPE).encode(x, add_special_tokens=False).ids)
    for w in windows.collect():
        turns = parse_window(w["text"])
        assert len(turns) == w["turns"] and w["n_tokens"] == count(w["text"])
        assert w["n_tokens"] <= 120 or w["turns"] == 1
        if w["window"] and by[w["conv_id"]][0][0] == "system" and turns[0][0] != "system":
            assert w["turns"] - w["repeated"] == 1  # the system turn doesn't fit beside that turn
    assert read_back(chat_windows(df.limit(0), BPE)).count() == 0


def test_chat_budget_of_short_turns(spark):
    from strandloom.llm.chat import chat_windows

    turns = [(1, t, "system" if t == 0 else "assistant" if t % 2 else "user", "ok" if t % 7 else "<|im_end|>") for t in range(3000)]
    exact = Tokenizer.from_file(BPE)
    found = chat_windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), BPE, budget=2048, history=512).collect()
    sizes = [len(exact.encode(w["text"], add_special_tokens=False).ids) for w in found]
    assert sum(w["turns"] - w["repeated"] for w in found) == 3000
    assert max(sizes) <= 2048 and sizes == [w["n_tokens"] for w in found]
    assert all(x > 1900 for x in sizes[:-1])  # and the budget is used


def test_toxicity_held_out(spark):
    from strandloom.llm.toxicity import toxicity

    rng = random.Random(9)
    pool = [a + b + c for a in ("the", "er", "thion", "of", "reth") for b in ("an", "es", "ing", "ly", "nd", "o") for c in ("", "ou", "ha", "st", "ea", "on")]
    rows, labels = [(None, "x"), (9000, None), (9001, ""), (9002, "idiot")], []
    for i in range(900):
        bad = i % 5 == 0
        w = [rng.choice(pool) for _ in range(rng.randint(20, 120))]
        for _ in range(4 if bad else 0):
            w[rng.randrange(len(w))] = rng.choice(["worthless", "disgusting", "pathetic"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, y int")
    lab = spark.createDataFrame([*labels, labels[0], (None, 1, 1), (77777, None, None)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in toxicity(df, lab).collect()}
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found.values())
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(found[i]["held_out"] for i in held)
    assert sum(found[i]["predicted"] == (i % 5 == 0) for i in held) / len(held) > 0.95
    assert toxicity(df, lab.limit(0)).count() == len(rows) and toxicity(df.limit(0), lab).count() == 0
    # repeated rows of a labelled id, and texts that don't fit the sample, change neither memory nor which rows come back
    again = df.unionByName(df.filter("doc_id < 50"))
    few = toxicity(again, lab, sample_bytes=60_000).collect()
    assert len(few) == len(rows) + 50 and sum(r["predicted"] for r in few if r["doc_id"] in held and r["doc_id"] % 5 == 0) / sum(i % 5 == 0 for i in held) > 0.8
    assert toxicity(df, spark.createDataFrame([(7, 0, 0), (14, 0, 1)], "doc_id long, quality int, toxic int")).count() == len(rows)


def test_quality_held_out(spark):
    from strandloom.llm.quality import quality_scores

    rng = random.Random(10)
    pool = [a + b for a in ("the", "er", "thion", "of", "reth") for b in ("an", "es", "ing", "ly", "nd", "o")]
    rows = [(None, "x"), (9000, None), (9001, " "), (9002, "The end.")]
    good = {}
    for i in range(600):
        w = [rng.choice(pool) for _ in range(rng.randint(30, 200))]
        kind = i % 8
        good[i] = kind > 2
        text = {0: " ".join(x + rng.choice(["***", "%%%", "$$$"]) for x in w), 1: " ".join(x.upper() + "!!" for x in w), 2: " ".join(x for x in w[:4] for _ in range(30))}.get(kind, " ".join(w).capitalize() + ".")
        rows.append((i, text))
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, quality_score double")
    found = quality_scores(df)
    assert found.count() == len(rows)
    by = {r["doc_id"]: r["quality_kept"] for r in found.collect()}
    assert not by[9000] and not by[9001] and by[9002]
    assert sum(by[i] == good[i] for i in good) / len(good) > 0.97
    assert quality_scores(df.limit(0)).count() == 0


def test_quality_is_fitted_outside_the_driver(spark, monkeypatch):
    """The driver gets the weights, not the sample."""
    from strandloom.llm import quality as Q

    driver, fit = os.getpid(), Q.fit

    def elsewhere(*args):
        assert os.getpid() != driver
        return fit(*args)

    monkeypatch.setattr(Q, "fit", elsewhere)
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(["the", "other", "thing", "is", "ready"]) + (rng.choice(["***", "%%%"]) if i % 4 == 0 else "") for _ in range(80))) for i in range(80)]
    found = Q.quality_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows) and all(r["quality_kept"] == (r["doc_id"] % 4 > 0) for r in found)


def test_driver_gives_native_memory_back(spark):
    from strandloom.operators import shared

    version = [int(x) for x in spark._jvm.java.lang.System.getProperty("java.version").split("-")[0].split(".")]
    if version >= [17, 0, 9] and os.path.exists("/proc/self/smaps_rollup"):
        assert shared.trim_jvm(spark)
    shared.release(spark)


def test_labellers_are_learnt():
    from strandloom.llm import quality as Q

    clean = [1] * 7
    one = [[-1 if i == k else 1 for i in range(7)] for k in range(7)]
    pairs = [[-1, 1, 1, 1, 1, 1, -1], [1, -1, -1, 1, 1, 1, 1], [1, 1, 1, 1, -1, -1, 1]]

    def learnt(*rows):
        votes = np.array([r for r, _ in rows])
        share, table = Q.accuracies(Q.code(votes), np.array([n for _, n in rows], float))
        return Q.posterior(votes + 1, share, table), table

    for rows in ([(clean, 700), *((x, 30) for x in one)], [(clean, 600), *((x, 150) for x in pairs)], [(clean, 500)], [(clean, 990), (one[0], 10)]):
        good, _ = learnt(*rows)
        assert good[0] > 0.5 and (good[1:] < 0.5).all()
    good, table = learnt((clean, 850), (one[0], 5), (one[3], 5), (pairs[0], 140))
    assert good[2] > 0.9 > 0.5 > good[1] > good[3]  # a labeller that finds nothing bad else counts for less
    assert table[0][0] < 0.6 < table[0][3]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    df, _ = documents(spark)
    df = df.select("doc_id", "text", "lang", "source", "n_chars")
    leak = "a passage of the benchmark that some document happens to hold in full, with enough words"
    df = df.unionByName(spark.createDataFrame([(700, "So " + leak + " it goes on.", "en", None, 1)], "doc_id long, text string, lang string, source string, n_chars long"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, leak), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == df.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.filter("doc_id = 700").count() == 0 and docs.count() > 20
    assert docs.filter("n_chars <> length(text)").count() == 0
    assert P.run(spark, str(tmp_path)).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_suffix_of_anchors_with_many_surroundings(spark):
    """One passage in thousands of different surroundings: its anchors are dealt over buckets and compared across them."""
    from strandloom.llm.suffix import digests, repeated_spans

    rng = random.Random(12)
    passage = "".join(rng.choice("abcdefgh") for _ in range(70))
    rows = []
    for i in range(2600):
        side = f"{i % 1300:06d}" * 12  # each surrounding in two documents
        rows.append((i, side + passage + side))
    df, _ = documents(spark, rows)
    found = got(digests(repeated_spans(df, 100)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert found == plain_spans(rows, 100)


def test_suffix_dealt_anchors(spark):
    """More surroundings than MANY: strings of dealt anchors come back as digests."""
    from strandloom.llm import suffix as S

    rng = random.Random(13)
    passage = "".join(rng.choice("abcdefgh") for _ in range(70))
    rows = []
    for i in range(S.MANY + 500):
        side = f"{i % (S.MANY + 300):06d}" * 6  # the last two hundred are copies
        rows.append((i, side + passage + side))
    df, _ = documents(spark, rows)
    found = got(S.digests(S.repeated_spans(df, 100)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert found == plain_spans(rows, 100)


def test_suffix_bucket_compares_in_few_passes(monkeypatch):
    """Anchors with 2 to FEW surroundings are compared together, however many pairs they have, and equal rows in the order of their chunks."""
    import pyarrow as pa

    from strandloom.llm import suffix as S

    rng, rows, want = random.Random(14), [], []
    for c in range(2, S.FEW + 1):
        passage = bytes(rng.randrange(256) for _ in range(114))
        for k in range(c):
            side = bytes([97 + k]) * 10
            rows.append((passage[40:64], -1, side + passage + side, 50, 100 * c + k, 0, 0, c, 1000 * k))
            want += [(c, 1000 * k + 10, 1000 * k + 124)] if k else []
    twice = bytes(rng.randrange(256) for _ in range(130))
    rows += [(twice[50:74], -1, twice, 50, 7, 0, 0, chunk, 0) for chunk in (91, 90)]
    want.append((91, 0, 130))
    calls, reach = [], S._reach
    monkeypatch.setattr(S, "_reach", lambda *a: calls.append(1) or reach(*a))
    names = [x.split()[0] for x in S.SUFFIX.split(", ")]
    for _ in range(2):
        rng.shuffle(rows)
        spans = S._bucket(pa.table(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))), 100)[0]
        assert sorted(zip(*(x.tolist() for x in spans), strict=True)) == sorted(want)
    assert len(calls) <= 4  # to the right and to the left, each time


def test_top_k_refuses_what_does_not_fit(spark):
    from strandloom.llm.topk import exact_top_k

    for x in (1e17, 1e9):
        df = spark.createDataFrame([(1, [x, x]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="64 bits"):
            exact_top_k(df, F.col("vec_id") > 0).count()
