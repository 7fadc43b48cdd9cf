"""Each operator against a brute-force version, and its edge cases."""

import base64
import codecs
import collections
import gzip
import hashlib
import json
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuscle.llm import ann, bpe, exact_dedup, html_text, mixing, ngram_join, secrets, token_ids, toxicity, warc, words
from corpuscle.llm.components import components

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, epoch int, key string, doc string, k long, rank int, value string"
LONG = "the quick brown fox jumps over the lazy dog again " * 4000
ROWS = [
    (1, "one two three four five six seven eight nine ten", "en", "a", 10),
    (2, "one two three four five six seven eight nine ten", "en", "a", 10),
    (2, "one two three four five six seven eight nine ten", "en", "a", 10),
    (3, None, "en", None, None),
    (4, "", "en", "b", 0),
    (5, " \n\t ", None, "b", 3),
    (6, "Short Text", "en", "b", 10),
    (7, LONG, "en", "a", len(LONG)),
    (None, "no id here but some words are there for sure", "en", "c", 1),
    (8, "\x00 odd <|endoftext|> 中文字 😀 é  \n\n x", "zh", "c", 1),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(*r, 7, "x", "y", 1, 2, "z") for r in ROWS], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def texts(n, seed):
    r = random.Random(seed)
    parts = ["a", "th", "er", " ", "  ", "\n", "'s", "'ll", "é", "中", "1", "23", "!", "...", "\x1c", "\x85", "<|endoftext|>", "😀", " \n", "ing", "x\n"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(n)]


def test_ann_own_rows_leave_room_for_others(spark):
    """A query row that occurs many times still gets its k nearest others."""
    r = random.Random(4)
    vec = lambda: [r.gauss(0, 1) for _ in range(8)]
    same = vec()
    rows = [(50, same)] * 9 + [(i, vec()) for i in range(1, 40)] + [(41, same), (42, same)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [x["rank"] for x in got] == [1, 2, 3, 4, 5] and [x["vec_id"] for x in got[:2]] == [41, 42] and all(x["vec_id"] != 50 for x in got)


def test_near_copies_go_by_text_too(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (7, a), (7, b), (9, c), (7, b), (None, a), (8, None), (8, b + " more")]
    got = ngram_join.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(1, a), (7, b), (7, b), (9, c), (None, a), (8, None)], key=str)


# BPE


def test_bpe_equals_the_library(tokenizer):
    codec = bpe.Bpe(PATH)
    for s in [*texts(3000, 1), "a" * 700, "ab" * 400, "=" * 900, " " * 600, "中文" * 200, "word " * 30000, LONG, *blanks(500, 9)]:
        ids = tokenizer.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(b"".join(codec.encode(s)), "<u4").tolist() == ids
        assert "".join(codec.decode([np.array(ids, "<u4").tobytes()])) == tokenizer.decode(ids, skip_special_tokens=False)


def test_transducer_is_exact_and_keeps_little(tokenizer):
    codec, r = bpe.Bpe(PATH), random.Random(2)
    assert codec.lookahead < 1000
    for _ in range(60):
        s = "".join(r.choice("theaonrsl") for _ in range(r.randint(1, 900)))
        raw = s.encode()
        assert list(codec.transduce([raw[:7], raw[7:400], raw[400:]])) == tokenizer.encode(s, add_special_tokens=False).ids
    for s in ["abcde" * 4000, "".join(r.choice("theaonrsl") for _ in range(30000)), "a" * 30001, "=" * 20003]:
        given, waiting = 0, [0]

        def blocks():
            for i in range(0, len(s), 100):  # noqa: B023
                waiting.append(i - sum(codec.sizes[t] for t in ids))  # noqa: B023
                yield s[i : i + 100].encode()  # noqa: B023

        ids = []
        for t in codec.transduce(blocks()):
            ids.append(t)
        assert ids == tokenizer.encode(s, add_special_tokens=False).ids
        assert max(waiting) <= 5 * codec.lookahead + 200


def test_every_id_comes_from_the_transducer():
    codec = bpe.Bpe(PATH)
    words_of = ["one two\nthree", "x  y", "<|endoftext|>a", "z" * 5000]
    got = [b"".join(blocks) for blocks in codec.encode_all(pa.array(words_of))]
    learnt = sum(len(g) for g in got) // 4
    before = codec.emitted
    assert before >= learnt - 1  # all but the special token
    assert [b"".join(blocks) for blocks in codec.encode_all(pa.array(words_of[:1]))] == got[:1] and codec.emitted == before


def toy_codec(folder, seed):
    """A codec of a random merge list over three letters, and its merges as strings."""
    r = random.Random(seed)
    shown = {v: k for k, v in bpe.byte_alphabet().items()}
    vocab = {shown[b]: b for b in range(256)}
    tokens, merges = ["a", "b", "c"], []
    while len(merges) < 14:
        x, y = r.choice(tokens), r.choice(tokens)
        if len(x + y) <= 6 and x + y not in vocab:
            merges.append((x, y))
            vocab[x + y] = len(vocab)
            tokens.append(x + y)
    path = folder / f"toy{seed}.json"
    path.write_text(json.dumps({"model": {"type": "BPE", "vocab": vocab, "merges": [f"{x} {y}" for x, y in merges]}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "normalizer": None, "added_tokens": []}))
    return bpe.Bpe(str(path)), merges, vocab


def rule_by_rule(text, merges):
    parts = list(text)
    for x, y in merges:
        i = 0
        while i + 1 < len(parts):
            if parts[i] == x and parts[i + 1] == y:
                parts[i : i + 2] = [x + y]
            i += 1
    return parts


@pytest.mark.parametrize("seed", range(12))
def test_lookahead_is_sufficient(tmp_path, seed):
    codec, merges, vocab = toy_codec(tmp_path, seed)
    r = random.Random(seed)
    for _ in range(150):
        text = "".join(r.choice("abc") for _ in range(r.randint(1, 160)))
        whole = rule_by_rule(text, merges)
        assert list(codec.transduce([text.encode()])) == [vocab[t] for t in whole]
        cut = r.randint(0, len(text))
        ends = lambda parts: set(np.cumsum([len(p) for p in parts]).tolist())
        stable = range(1, cut - codec.lookahead + codec.max_token + 1)  # the chain alone: max_token is for the last token
        assert not {p for p in ends(whole) ^ ends(rule_by_rule(text[:cut], merges)) if p in stable}


def test_decoder_keeps_unfinished_characters():
    codec = bpe.Bpe(PATH)
    ids = [codec.base[b] for b in "é😀".encode()] + [codec.base[0xFF]]
    out = list(codec.decode([np.array([i], "<u4").tobytes() for i in ids]))
    assert "".join(out) == codecs.decode("é😀".encode() + b"\xff", "utf-8", "replace")


def test_encode_table(spark, edge, empty, tokenizer):
    for row in bpe.encode_table(edge, PATH, keep=("source",)).collect():
        text = next(r[1] for r in ROWS if r[0] == row.doc_id) or ""
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_table(empty, PATH).count() == 0
    assert bpe.encode_ids(edge, PATH).where("doc_id = 6").first().token_ids == tokenizer.encode("Short Text").ids


# token-id files


@pytest.mark.parametrize("values", [[], [0], [255, 256, 65535, 65536, 2**24, 2**32 - 1], list(range(0, 70000, 7))])
def test_pack_round_trip(values):
    v = np.array(values, np.uint32)
    control, data = token_ids.pack(v)
    assert token_ids.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(v)).tolist() == values


def blanks(n, seed):
    r = random.Random(seed)
    parts = ["a", "word", "don't", "x,", "é.", "9!", " ", " ", " ", "\n", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c", "\u2028", "\u00a0", "ſ;", "中:", "Ω?", ".."]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_library_encoder(tokenizer):
    encoder = token_ids.LibraryEncoder(PATH)
    sample = [*texts(3000, 3), *blanks(20000, 4), "a word\n\nand, more.\nof it"]
    assert words.regular(pa.array(sample), encoder.marks).sum() > 4000
    for a in range(0, len(sample), 1000):
        ids, counts = encoder.encode(pa.array(sample[a : a + 1000]))
        ends = np.cumsum(counts)
        for s, e, n in zip(sample[a : a + 1000], ends.tolist(), counts.tolist(), strict=False):
            assert ids[e - n : e].tolist() == tokenizer.encode(s, add_special_tokens=False).ids, s


def test_word_pool_stays_small(tokenizer):
    encoder = token_ids.LibraryEncoder(PATH)
    encoder.words.most = 20_000
    for a in range(0, 20_000, 500):
        batch = [f"the w{i} of x{i * 7}, and" for i in range(a, a + 500)]
        ids, _ = encoder.encode(pa.array(batch))
        assert ids.tolist() == [x for s in batch for x in tokenizer.encode(s, add_special_tokens=False).ids]
        assert len(encoder.words.words) < 2500


def test_token_files(spark, edge, empty, tokenizer, small):
    for docs in (edge, spark.read.parquet(f"{small}/documents.parquet")):
        got = sorted(token_ids.token_id_table(docs, PATH).collect(), key=lambda r: r.start)
        rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
        assert [r.doc_id for r in got] == [r.doc_id for r in rows]
        start = 0
        for g, r in zip(got, rows, strict=True):
            ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
            assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)
    assert token_ids.token_id_table(empty, PATH).count() == 0


# exact duplicates


def test_exact_groups(edge, empty):
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_groups(edge).collect()}
    assert exact_dedup.exact_groups(edge).count() == len(ROWS)
    for i, t, *_ in ROWS:
        r = got[i, hashlib.sha256((t or "").encode()).hexdigest()]
        same = [j for j, u, *_ in ROWS if (u or "") == (t or "")]
        assert r.group_size == len(same)
        assert r.keep_id == max((j for j in same if j is not None), default=None)
        assert r.kept == (i == r.keep_id)
    assert exact_dedup.exact_groups(empty).count() == 0
    kept = exact_dedup.drop_copies(edge)
    assert kept.columns == edge.columns and sorted(r.doc_id for r in kept.where("doc_id < 4").collect()) == [2, 2]
    least = {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(edge, largest=False).where("doc_id IN (1, 2)").collect()}
    assert least == {1: 1, 2: 1}


def test_tree_merges_sorted_runs(spark):
    r = random.Random(10)
    rows = [(i if r.random() < 0.7 else None, f"t{r.randint(0, 40) if r.random() < 0.6 else 0}") for i in range(3000)]
    keyed = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", *exact_dedup.digest_key(F.col("text"), F.unhex(F.sha2(F.col("text").cast("binary"), 256))))
    want = collections.defaultdict(list)
    for i, t in rows:
        want[t].append(i)
    for largest, run_rows in ((True, 1 << 20), (False, 1 << 20), (True, 3), (False, 3)):  # 64 runs, and as many as 3 rows ask for
        best = max if largest else min
        for x in exact_dedup.tree_keep(keyed, "doc_id", largest, run_rows).collect():
            ids = [i for i in want[x.text] if i is not None]
            assert (x.keep_id, x.group_size) == (best(ids, default=None), len(want[x.text]))
    plan = exact_dedup.tree_keep(keyed, "doc_id").select("keep_id")._jdf.queryExecution().toString()
    assert "Python" not in plan


# near duplicates


def brute_groups(rows, n=5, percent=80):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append((i, frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return collections.Counter((i, len(s), least.get(find(a))) for a, (i, s) in enumerate(sets))


def near_rows(seed, families=12, size=14):
    r = random.Random(seed)
    rows = []
    for f in range(families):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.randint(6, 140))]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                at = r.randrange(len(w))
                w[at : at + r.randint(0, 2)] = [f"W{r.randint(0, 400)}"] * r.randint(0, 2)
            rows.append((len(rows) * 3 + f % 2, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_groups(spark, seed):
    rows = near_rows(seed)
    got = ngram_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert collections.Counter(map(tuple, got.collect())) == brute_groups(rows)


def test_near_groups_of_hot_blocks(spark):
    """With blocks of more than two rows spread over tasks, nothing changes."""
    rows = near_rows(4, families=5)
    got = ngram_join.near_groups(spark.createDataFrame([*rows, *rows[:5]], "doc_id long, text string").repartition(3), hot=2)
    assert collections.Counter(map(tuple, got.collect())) == brute_groups([*rows, *rows[:5]])


def test_nodes_of_clashing_digests():
    one, two = np.array([1], np.uint64), np.array([2], np.uint64)
    first, second = ngram_join.fingerprint(one)
    assert ngram_join.fingerprint(two) != (first, second)
    assert ngram_join.node_of(one, frozenset()) == first and ngram_join.node_of(one, frozenset([first])) == second


def test_near_groups_edges(spark, edge, empty):
    got = collections.Counter(map(tuple, ngram_join.near_groups(edge).collect()))
    assert got == brute_groups([r[:2] for r in ROWS])
    # without identifiers: near copies of a named text, copies among themselves, and a text of its own
    words_of = [f"w{i}" for i in range(60)]
    rows = [(9, " ".join(words_of)), (None, " ".join([*words_of, "x"])), (None, " ".join([*words_of, "x"])), (None, " ".join(words_of[::-1])), (4, " ".join(words_of[::-1]) + " y"), (None, "alone as can be, it stays"), (None, None), (None, "")]
    named = spark.createDataFrame(rows, "doc_id long, text string")
    assert collections.Counter(map(tuple, ngram_join.near_groups(named).collect())) == brute_groups(rows)
    assert ngram_join.near_groups(empty).count() == 0
    kept = ngram_join.drop_near_copies(edge)
    assert kept.columns == edge.columns and kept.where("doc_id = 2").count() == 0 and kept.where("doc_id IN (3, 4, 5)").count() == 3


def test_products_of_near_copies_grow_with_their_number(spark):
    """Twins share 17 of 30 entries, others 13, one less than the bound: only the first entries of twins are multiplied."""
    for size in (20, 40):
        rows = [(i // 2 * 100 + j if j < 17 else -j, i, 146, j, j - 12, 17, i) for i in range(size) for j in range(13, 30)]
        mixed = spark.createDataFrame(rows, "s long, k long, n long, place long, rank long, shared long, c long")
        assert ngram_join.first_in_common(mixed, 80).count() == size // 2 * 4
        assert sorted(map(tuple, ngram_join.across_components(mixed, 80).collect())) == [(i, i + 1) for i in range(0, size, 2)]


def test_bounds_never_lose_a_link(spark):
    rows = [(x, y) for x in range(1, 60) for y in range(1, 60)]
    df = spark.createDataFrame(rows, "x long, y long")
    got = df.select("x", "y", ngram_join.least_overlap(F.col("x"), F.col("y"), 80).alias("o"), ngram_join.least_count(F.col("x"), F.col("y"), 80).alias("c"), ngram_join.sizes_fit(F.col("x"), F.col("y"), 80).alias("fit")).collect()
    for r in got:
        linked = [o for o in range(min(r.x, r.y) + 1) if 100 * o >= 80 * (r.x + r.y - o)]
        assert not linked or r.fit
        if linked:
            assert linked[0] == r.o
            kept = lambda n: n - -(-80 * n // 100) + 1
            assert r.c <= min(kept(r.x) - (r.x - r.o), kept(r.y) - (r.y - r.o))


def test_components(spark):
    r = random.Random(4)
    pairs = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    odd = spark.createDataFrame([(None, 1, "x"), (2, None, "x"), (7, 7, "x"), (3, 5, "x"), (5, 3, "x"), (3, 5, "x")], "a long, b long, u string")
    assert {(x.node, x.component) for x in components(odd).collect()} == {(3, 3), (5, 3)} and components(odd.limit(0)).count() == 0
    got = {x.node: x.component for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    assert got == {x: find(x) for x in parent}


# mixing


def test_mixing_keeps_every_document(edge, empty):
    rows = mixing.mixture(edge).collect()
    assert {r.doc_id for r in rows} == {r[0] for r in ROWS}
    assert max(collections.Counter((r.doc_id, r.epoch) for r in rows if r.doc_id not in (2,)).values()) == 1
    assert all(1 <= r.repetition <= 2 + 1e-6 and r.schedule < 1 for r in rows)
    assert mixing.mixture(empty).count() == 0
    out = mixing.mix(edge)
    assert out.columns == edge.columns and out.count() == len(rows)


def test_mixing_keeps_null_sources_apart(spark):
    rows = [(i, "w " * 5, [None, "\x00", "a"][i % 3]) for i in range(300)] + [(i, "w " * 5, "a") for i in range(300, 900)]
    got = mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id for r in got} == set(range(900))
    assert len({r.repetition for r in got if r.source != "a"}) == 1 and {r.repetition for r in got if r.source is None} == {2.0}


def test_mixing_meets_its_targets(spark):
    rows = [(i, "w " * 10, "big" if i % 20 else ("mid" if i % 40 else "low")) for i in range(4000)]
    docs = spark.createDataFrame([(i, t, None, s, 1) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    by = mixing.mixture(docs, 3.0).groupBy("source").agg(F.sum("n_tokens").alias("t"), F.max("repetition").alias("r")).collect()
    assert max(r.r for r in by) == pytest.approx(3.0, abs=1e-4)
    share = {r.source: r.t for r in by}
    assert share["low"] == pytest.approx(3 * 1000, rel=0.15)
    flat = mixing.mixture(docs, None, 0.9).groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()
    p = np.array([r.t for r in flat]) / sum(r.t for r in flat)
    assert -(p * np.log(p)).sum() == pytest.approx(0.9 * np.log(3), abs=0.03)


# secrets


def brute_secrets(t):
    t = t or ""
    kinds = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16)]
    base = sorted((m.start(), k, m.end(), n) for k, (n, p, g, least) in enumerate(kinds) for m in p.finditer(t) if len(m[g]) >= least)
    more = []
    for m in re.finditer(secrets.CANDIDATE, t):
        v = m[0]
        if not (re.search("[0-9]", v) and re.search("[A-Za-z]", v)) or any(re.search(a, v) for a in secrets.ALLOW) or any(b[0] < m.end() and m.start() < b[2] for b in base):
            continue
        best = max(-sum(c / 20 * np.log2(c / 20) for c in collections.Counter(v[i : i + 20]).values()) for i in range(len(v) - 19))
        if best >= secrets.THRESHOLDS["hex" if re.fullmatch("[0-9a-fA-F]+", v) else "any"] - 1e-9:
            more.append((m.start(), 3, m.end(), "entropy"))
    shown = lambda x: ",".join(f"{n}:{s}:{e}" for s, _, e, n in sorted(x))
    return [*(sum(b[1] == k for b in base) for k in range(3)), hashlib.sha256(shown(base).encode()).hexdigest(), shown(base + more), len(more)]


def test_secrets(spark, edge, empty):
    r = random.Random(5)
    parts = ["password", "Token", "SECRET", "api_key", "apikey", "=", ":", " ", "'", '"', "abc", "0123456789abcdef", "AKIA", "ABCDEFG", "XYZ123", "é", "😀", "\n", "Zm9vYmFy+/9", "q8Wz3LkP0xT7vB", "deadbeef", "example", "ſecret"]
    rows = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(600)] + [None, "", "password = aaaaaaaaaaaaaaaa\n" * 700]
    got = secrets.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert sum(x.n_entropy for x in got.collect()) > 50
    for x in got.collect():
        assert list(x)[1:] == brute_secrets(rows[x.doc_id]), rows[x.doc_id]
    assert secrets.scan(edge).count() == len(ROWS) and secrets.scan(empty).count() == 0


def test_long_candidates_take_linear_time(spark):
    r = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    value = lambda n: "".join(r.choices("ab1", k=n - 40) + r.choices(letters, k=40))
    short, long = [(1, value(10_000))], [(1, value(80_000))]

    def seconds(rows):
        began = time.perf_counter()
        got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert list(got[0])[1:] == brute_secrets(rows[0][1])
        return time.perf_counter() - began

    seconds(short)
    assert seconds(long) < 2 + 12 * seconds(short)


# WARC


@pytest.mark.parametrize("version", [1, 2])
def test_arc_to_warc(version):
    pages = [("http://a/b c", b"x\n\r\n\r\ny"), ("http://d", b""), (None, "é".encode())]
    raw = warc.arc_head(version) + b"".join(warc.arc_line(u, len(p), "20240102030405", version=version).encode() + p + b"\n" for u, p in pages)
    records = list(warc.parse_arc(raw))
    assert [r.payload for r in records] == [p for _, p in pages] and records[0].fields["URL"] == "http://a/b%20c"
    out = b"".join(map(warc.to_warc, records))
    for (f, block), (_, p) in zip(warc.parse_warc(out), pages, strict=True):
        assert block == p and f["warc-date"] == "2024-01-02T03:04:05Z"
        assert f["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(p).digest()).decode()
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"http://a 0.0.0.0 20240101000000 text/html 10\nabc"))


@pytest.mark.parametrize("version", [1, 2])
def test_convert_arc_files(spark, tmp_path, version):
    """ARC files as a crawler leaves them, plain and packed, any bytes, with and without HTTP headers."""
    bodies = [b"\xff\xfe\x00 no utf-8", b"", b"x" * 100, b"\r\n\r\nWARC/1.1\r\n", b"x" * 100, bytes(range(256)) * 40]
    messages = [warc.http_message(b, str(i)) if i != 3 else b for i, b in enumerate(bodies)]
    lines = [warc.arc_line(f"http://h/{i}", len(m), "20010203040506", version=version).encode() + m + b"\n" for i, m in enumerate(messages)]
    arc, out = tmp_path / "arc", tmp_path / "warc"
    arc.mkdir()
    (arc / "a.arc").write_bytes(warc.arc_head(version) + b"".join(lines[:2]))
    (arc / "b.arc.gz").write_bytes(b"".join(map(gzip.compress, [warc.arc_head(version), *lines[2:]])))
    warc.convert(spark, str(arc), str(out))
    got = {r.url: r for r in warc.read_archive(spark, str(out)).collect()}
    for i, b in enumerate(bodies):
        r = got[f"http://h/{i}"]
        assert (r.payload_bytes, r.payload_digest, r.date) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "2001-02-03T04:05:06Z")
        assert (r.page_id, r.record_type, r.refers_to) == (None if i == 3 else i, "revisit" if i == 2 else "response", 4 if i == 2 else None)


def test_files_are_bounded_by_bytes():
    files = list(warc.to_files((bytes([i]) * 1000 for i in range(100)), b"head", 10_000))
    assert [len(gzip.decompress(f)) for f in files] == [10_004] * 10
    assert gzip.decompress(files[0] + b"\0") == gzip.decompress(files[0])
    assert list(warc.to_files(iter(()), b"head")) == []


def test_archive(spark, small):
    rows = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "u", ""), (None, "n", "<p>x</p>"), (5, "v", "\r\n\r\nWARC/1.1 é"), (5, "w", "<p>x</p>")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, key string")
    got = collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archived_pages(pages).collect())
    x = len("<p>x</p>")
    assert got == collections.Counter([(1, x, "revisit", 5), (2, x, "revisit", 5), (3, 0, "revisit", 4), (4, 0, "response", None), (None, x, "response", None), (5, len("\r\n\r\nWARC/1.1 é".encode()), "response", None), (5, x, "response", None)])
    assert warc.archived_pages(pages.limit(0)).count() == 0
    real = spark.read.parquet(f"{small}/pages.parquet")
    digests = {r.page_id: r.payload_digest for r in warc.archived_pages(real).collect()}
    assert digests == {r.page_id: base64.b32encode(hashlib.sha1(r.html.encode()).digest()).decode() for r in real.collect()}


# HTML


def test_min_cut_is_minimal():
    r = random.Random(6)
    for _ in range(150):
        n = r.randint(1, 7)
        a, b = [r.randint(0, 20) for _ in range(n)], [r.randint(0, 20) for _ in range(n)]
        edges = [(i, j, r.randint(0, 9)) for i in range(n) for j in range(i) if r.random() < 0.5]
        cost = lambda s: sum(b[i] if s >> i & 1 else a[i] for i in range(n)) + sum(c for i, j, c in edges if (s >> i ^ s >> j) & 1)  # noqa: B023, E731
        got = sum(1 << i for i, keep in enumerate(html_text.min_cut(a, b, edges)) if keep)
        assert cost(got) == min(map(cost, range(1 << n)))


PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body><header class="site"><p>Tag line of the site, for all.</p></header>
<nav><ul><li><a href=1>Home</a></li></ul></nav><div id="cookie-notice"><p>We use cookies to make this site better, so you agree.</p></div>
<aside class="sidebar"><h3>Popular</h3><p>Many other things, listed in the side bar here.</p></aside><main><article><header><h1>Title &amp; more</h1></header>
<p>Short.</p><p>A <a href=2>link</a> in\n\n text,&nbsp;which is long enough.</p><div class="ad">Buy now, great prices, all must go!</div><ul><li>one</li><li>two</li></ul></article>
<section class="comments"><p>I think that this is great, thank you for all of it.</p><form><label>Name</label><textarea>x</textarea></form></section></main>
<footer><p>&copy; 2020, all rights reserved, by us.</p></footer></body></html>"""


P1 = "The committee met on Tuesday, and after two hours of debate it agreed, by a narrow margin, to fund the bridge."
P2 = "Work is to begin in the spring, the mayor said, once the river has fallen; it should last about two years."
LINKED = "<a href=x>The full report of the committee on the bridge</a>"
#: Pages of several makes, and what an editor would keep; one block of each has evidence of its own against it.
TEMPLATES = {
    "unnamed boxes, a paragraph that is a link": (
        f"<body><div><div><a href=1>Home</a></div><div><a href=2>News</a></div><div><a href=3>Sport</a></div></div><div><p>{P1}</p><p>{LINKED}</p><p>{P2}</p></div></body>",
        [P1, "The full report of the committee on the bridge", P2],
    ),
    "unnamed boxes, a sentence among links": (
        f"<body><div><div><a href=1>Home</a></div><div><a href=2>News</a></div><div>Welcome, dear reader.</div><div><a href=3>Sport</a></div><div><a href=4>Town and country</a></div></div><div><p>{P1}</p><p>{P2}</p></div></body>",
        [P1, P2],
    ),
    "a table as a frame": (
        f"<table><tr><td><div><a href=1>Home</a></div><div>See also:</div><div><a href=2>Archive of the year</a></div></td><td><div><p>{P1}</p><p>{LINKED}</p><p>{P2}</p></div></td></tr></table>",
        [P1, "The full report of the committee on the bridge", P2],
    ),
    "sections with a list of links that belongs to the text": (
        f"<body><nav><a href=1>Home</a></nav><div id=content><section><h2>Sources</h2><p>{P1}</p><p>{LINKED}</p><p>{P2}</p></section></div><div class=footer-links><p>{P2}</p></div></body>",
        ["Sources", P1, "The full report of the committee on the bridge", P2],
    ),
}


@pytest.mark.parametrize("name", TEMPLATES)
def test_cut_overrules_scores(name):
    html, want = TEMPLATES[name]
    by_score = [b.text for b in html_text.blocks_of(html) if html_text.score(b) > 0]
    assert html_text.main_blocks(html) == want and by_score != want


PARAS = ["The council met on Monday evening to talk about the new bridge, and it agreed on a plan.", "Work will begin in the spring, the mayor said, and it should end before the next winter comes."]
AROUND = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav>"
AFTER = "<footer><p>All rights reserved, by the makers of this site, in all countries.</p></footer>"
PP = "".join(f"<p>{p}</p>" for p in PARAS)
NOTE = "<p>I do not agree at all with this, and neither do my neighbours, who wrote it.</p>"
MAKES = {
    "no-sidebar": f"<body class='single-post no-sidebar'>{AROUND}<article>{PP}</article>{AFTER}",
    "with-sidebar": f"<body>{AROUND}<div class='layout with-sidebar'><article>{PP}</article><div class='sidebar'><p>Buy now, while it is cheap, all of it.</p></div></div>{AFTER}",
    "with-banner": f"<body>{AROUND}<div id='page-with-banner'><main>{PP}</main></div>{AFTER}",
    "comment-open": f"<body class='post comment-open'>{AROUND}<main>{PP}</main>{AFTER}",
    "article-header": f"<body>{AROUND}<article><div class='article-header'><h1>The bridge</h1></div>{PP}</article>{AFTER}",
    "title-attribute": f"<body>{AROUND}<div title='the hidden truth'>{PP}</div>{AFTER}",
    "form-around": f"<body><form id='aspnetForm'>{AROUND}<div id='content'>{PP}</div>{AFTER}</form>",
    "sidebar-right": f"<body>{AROUND}<main class='site-main sidebar'>{PP}</main>{AFTER}",
    "comments": f"<body>{AROUND}<article>{PP}</article><div id='comments'>" + f"<article class='comment'>{NOTE}</article>" * 9 + f"</div>{AFTER}",
    "related": f"<body>{AROUND}<main>{PP}</main><section class='related-posts'><article><p>Ten ways to cook an egg, and more.</p></article></section>{AFTER}",
    "html-class": f"<html class='no-js cookie-banner'><body class='sidebar widget'>{AROUND}<div class='entry-content'>{PP}</div>{AFTER}",
    "cookie": f"<body><div class='cookie-notice'><p>We use cookies, as all the others do, to know you.</p></div><div>{PP}</div>{AFTER}",
    "tables": f"<body bgcolor=white><table><tr><td class=menu><a href=a>One</a> <a href=b>Two</a></td><td>{PP}</td></tr></table>{AFTER}",
    "data-attribute": f"<body>{AROUND}<div data-hidden='x' data-class='sidebar'>{PP}</div>{AFTER}",
}


@pytest.mark.parametrize("make", sorted(MAKES))
def test_html_of_many_makes(make):
    want = [*(["The bridge"] if make == "article-header" else []), *PARAS]
    assert html_text.main_blocks(MAKES[make]) == want


def test_html_keeps_inline_content():
    page = "<article><p>The value of <math><mi>x</mi></math> is set, see <svg><text>fig</text></svg>.</p><object><p>Kept, as it is shown.</p></object><select><option>no</option></select></article>"
    assert html_text.main_text(page) == "The value of x is set, see fig.\nKept, as it is shown."


@pytest.mark.parametrize("piece", ["<div>x", "<a ", "<span>x", "<b><i>x</b>", "<ul><li>x", "<table><td>x", "<!-- x", '<a ">\'', "<b><hr>x"])
def test_html_time_is_linear(piece):
    def seconds(n):
        began = time.process_time()
        html_text.main_text(piece * n)
        return time.process_time() - began

    seconds(2000)
    assert min(seconds(32000) for _ in range(2)) < 0.02 + 9 * max(seconds(8000) for _ in range(3))


def test_html(spark, small):
    assert html_text.main_text(PAGE) == "Title & more\nShort.\nA link in text, which is long enough.\none\ntwo"
    assert html_text.main_text(None) == "" and html_text.main_text("<p>") == ""
    assert html_text.main_text("<div><p>abc def, ghi.</p><nav>x</nav></div>" * 5000).count("\n") == 4999
    rows = spark.createDataFrame([(1, "u", PAGE, 2), (1, "u", PAGE, 2), (None, None, None, 3)], "page_id long, url string, html string, text int")
    got = html_text.extract(rows).collect()
    assert sorted(r.n_chars for r in got) == [0, *[len(html_text.main_text(PAGE))] * 2] and html_text.extract(rows.limit(0)).count() == 0
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        body = re.search("<article>(.*)</article>", r.html, re.S)[1]
        from html import unescape

        blocks = [" ".join(unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", body)]
        assert html_text.main_text(r.html) == "\n".join(x for x in blocks if x)


@pytest.mark.parametrize("tag", sorted(html_text.RAW))
def test_text_after_an_unclosed_element(tag):
    text = "A long sentence, with marks and words enough to be content of the page. " * 3
    page = f"<html><body><article><p>{text}</p>{{}}<p>And then: {text}</p></article></body></html>"
    seen = lambda part: sum("And then" in b.text for b in html_text.blocks_of(page.format(part)))
    assert seen(f"<{tag}>") == seen(f"<{tag} a='b'><{tag}>") == (tag not in html_text.ENDLESS)
    assert seen(f"<{tag}>And then</{tag}>") == 1


# toxicity


def test_toxicity_learns_sentences(spark):
    r = random.Random(7)
    plain, bad = [f"word{i}" for i in range(300)], ["idiota", "idiots", "scumbag"]
    rows = []
    for i in range(800):
        lines = [" ".join(r.choices(plain, k=12)) for _ in range(6)]
        if i % 3 == 0:
            lines[2] += " " + r.choice(bad)
        rows.append((i, ". ".join(lines)))
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 1) for i in range(800)] + [(None, 1, 1), (5, None, 1)], "doc_id long, toxic int, text int")
    model = toxicity.train(docs, labels)
    got = toxicity.score_table(docs, model).collect()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    held = [x for x in got if x.held_out]
    assert sum(x.predicted == (x.doc_id % 3 == 0) for x in held) / len(held) > 0.95
    hit = [rows[x.doc_id][1][x.worst_start : x.worst_end] for x in held if x.predicted]
    assert sum(any(b in h for b in bad) for h in hit) / len(hit) > 0.95
    kept = toxicity.reject_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(1 - x.predicted for x in got)


def bags_of(texts_of, toxic):
    packed = toxicity.Packed()
    return toxicity.Bags.of([(*map(np.array, toxicity.sentences(t, packed)), y) for t, y in zip(texts_of, toxic, strict=True)])


def test_toxicity_gradient_and_scores_by_brute_force():
    r = random.Random(11)
    some = ["idiot", "fool,", "Bridge", "river", "ab", "abc", "!!", "été"]
    rows = ["".join(r.choice(some) + r.choice([" ", " ", ". ", "\n"]) for _ in range(r.randint(0, 14))) for _ in range(40)]
    toxic = [int("idiot" in t or "fool" in t) for t in rows]
    bags, rng = bags_of(rows, toxic), np.random.default_rng(1)
    model = toxicity.Model(rng.normal(size=1 << toxicity.BITS).astype(np.float32), -1.5)
    w, weight, every = model.weights.astype(float), toxicity.class_weights(bags.toxic, 0.3), np.ones(1 << toxicity.BITS)

    def probability(text, w, b):  # sentence by sentence, word by word
        rest = 1.0
        for part in re.split(r"[.!?\n]", text):
            if part.split():
                rest *= 1 - 1 / (1 + np.exp(-sum(w[f] for piece in part.split() for f in toxicity.features(piece)) - b))
        return 1 - rest

    def loss(w, b):
        return sum(c * -np.log(max(probability(t, w, b) if y else 1 - probability(t, w, b), 1e-9)) for t, y, c in zip(rows, toxic, weight, strict=True))

    got, g, gb = toxicity.gradient(bags, w, model.bias, weight, every)
    assert got == pytest.approx(loss(w, model.bias), rel=1e-6)
    step = 1e-5
    assert gb == pytest.approx((loss(w, model.bias + step) - loss(w, model.bias - step)) / (2 * step), rel=1e-4)
    for f in {f for p in some for f in toxicity.features(p)}:
        up, down = w.copy(), w.copy()
        up[f] += step
        down[f] -= step
        assert g[f] == pytest.approx((loss(up, model.bias) - loss(down, model.bias)) / (2 * step), rel=1e-3, abs=1e-7)
    words_of = toxicity.Words(model)
    for t in rows:
        assert toxicity.score(t, words_of, model.bias)[0] == pytest.approx(probability(t, w, model.bias), abs=1e-9)
    learnt = toxicity.fit(bags, 0.3)
    last, _, _ = toxicity.gradient(bags, learnt.weights.astype(float), learnt.bias, weight, every)
    assert last < toxicity.gradient(bags, w * 0, -1.0, weight, every)[0]


def test_toxicity_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i % 40, f"word{i} one two three. four") for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    rows, share = toxicity.examples(docs, labels, 30)
    assert len(rows) == 60 and sum(r[2] for r in rows) == 30 and 0 < share < 1
    rows, _ = toxicity.examples(docs, labels, 30, 52)
    assert [sum(len(r[0]) for r in rows if r[2] == c) for c in (0, 1)] == [50, 50]


def test_toxicity_edges(spark, edge, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(edge, none).collect()
    assert len(got) == len(ROWS) and {x.score for x in got} == {0.0}
    some = spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, toxic int")
    assert all(0 <= x.score <= 1 for x in toxicity.toxicity(edge, some).collect())
    assert toxicity.toxicity(empty, some).count() == 0


# nearest neighbours


def brute_nearest(rows, k=5, every=50):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    out = {}
    for i, q in good:
        if i % every == 0 and i not in out:
            near = sorted((-(q @ v) / np.sqrt((q @ q) * (v @ v)), j) for j, v in good if j != i and len(v) == len(q))
            out[i] = [(j, -c) for c, j in near[:k]]
    return out


def test_nearest(spark):
    r = np.random.default_rng(8)
    centres = r.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + r.normal(size=16) * 0.4).tolist()) for i in range(1500)]
    rows += [(i, rows[0][1]) for i in range(2000, 2100)] + [(3000, None), (3050, [0.0] * 16), (3100, [float("nan")] * 16), (3150, [None] * 16), (3200, [1.0, 2.0]), (None, rows[1][1]), (3250, [])]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<double>, id int")
    good = ann.usable(df, "vec_id", "embedding")
    index = ann.build_index(df, shard=400)
    got = collections.defaultdict(list)
    for x in ann.search_index(index, good.where("id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    want = brute_nearest(rows)
    assert set(got) == {q for q in want if want[q]}
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in got)
    assert hits / sum(len(want[q]) for q in got) >= 0.9
    assert [j for j, _ in got[2000]] == [0, 2001, 2002, 2003, 2004]
    vectors = {i: np.array(v, float) for i, v in rows if v and i is not None}
    for q, near in got.items():
        for j, c in near:
            assert c == pytest.approx(vectors[q] @ vectors[j] / np.linalg.norm(vectors[q]) / np.linalg.norm(vectors[j]), abs=1e-12)
    assert ann.nearest(df.limit(0)).count() == 0


def test_nearest_of_tiny_and_huge_vectors(spark):
    r = np.random.default_rng(9)
    rows = [(i, (r.normal(size=8) * s).tolist()) for i, s in enumerate([1e-200, 1e200, 1e-310, 1.0, 1e300] * 24)]
    got = {(x.query_id, x.rank): x for x in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    plain = [(i, ann.scaled(np.array(v)).tolist()) for i, v in rows]
    want = brute_nearest(plain)
    assert len(got) == 15
    for q, near in want.items():
        assert [got[q, k].vec_id for k in range(1, 6)] == [j for j, _ in near]
        assert [got[q, k].score for k in range(1, 6)] == pytest.approx([c for _, c in near], abs=1e-6 if q % 5 == 2 else 1e-12)
