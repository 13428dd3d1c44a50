"""Corpus operators against brute force, and on awkward tables."""

import base64
import hashlib
import math
import random
import re
import sys
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import (
    bpe, forest, importance, language, line_rules, mixing, quality, ranked_search, recompression, secrets, setsketch, sharding,
    token_files,
)
from docloom.llm.queries import ORACLES, QUERIES
from docloom.sources import SCHEMAS
from tools.check import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["size", "node", "key", "bucket", "n", "spans", "kept", "target", "text_hash", "owner", "start", "pieces", "score", "_row"]
RANKS = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.tiktoken")
PATTERN = pytest.importorskip("public_tokenizers").PATTERN


def words(text):
    return (text or "").encode().split()


def corpus(seed=3, n=150):
    """Random texts with copies, near copies, shared passages and awkward rows."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "naïve", "the", "the", "the"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 20, 90, 200]))) for _ in range(n)]
    texts += [texts[5]] * 60
    for i in range(40):
        near = texts[i].split()
        near[rng.randrange(len(near))] = f"new{i}"
        texts.append(" ".join(near).upper() if i % 9 == 0 else " ".join(near))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{t} {passage} tail{i}" for i, t in enumerate(texts[10:20])]
    texts += ["", " \t\n", "one", "a b c d", "a b c d", "a a a a " * 30, "x" * 5000, "word " * 20_000, "　   \u0001", "password = hunter22"]
    rows = [(i, t, "en" if i % 3 else "fr", f"s{i % 5}" if i % 2 else "hot", len(t)) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "no id " * 30, None, None, 1), (None, None, None, None, None), (9001, None, "en", None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHING}).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r)
    return out


def components(nodes, links):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


OPERATORS = {
    "secrets": secrets.find_secrets,
    "language": lambda d: language.identify(d, language.learn(d)),
    "mixing": mixing.mix_sources,
    "mixed": mixing.mixed_documents,
    "repeats": recompression.remove_repeats,
    "quality": lambda d: quality.score(d, quality.Model.fresh()),
    "rules": line_rules.apply_line_rules,
    "sharding": sharding.shard_documents,
    "near": setsketch.near_duplicates,
    "bpe": lambda d: bpe.round_trip(d, RANKS, PATTERN),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_each_and_none_for_an_empty_table(name, docs, empty):
    assert OPERATORS[name](empty).count() == 0
    if name != "mixed":
        got = Counter(r["doc_id"] for r in OPERATORS[name](docs).collect())
        assert got == Counter(r[0] for r in corpus())


def test_secrets_by_ownership(spark):
    live, shared = "aB3dE6gH9jK2mN5pQ8sT1v", "Zy9Xw8Vu7Ts6Rq5Po4Nm3L"
    rows = [(1, f"k {live} and secret: abc, token=abcdef", "a"), (2, f"x {shared} y", "a"), (3, f"{shared}", "b"), (4, f"é {live}", "a"), (5, None, None)]
    got = by_id(secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert got[1][0]["spans"] == "owned:2:24,assign:42:54" and got[1][0]["n_assign"] == 1
    assert got[2][0]["spans"] == got[3][0]["spans"] == ""
    assert got[4][0]["spans"] == "owned:2:24"
    assert got[5][0]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_secret_mask(spark):
    spans = F.expr("array(named_struct('start', 2L, 'end', 5L), named_struct('start', 3L, 'end', 5L), named_struct('start', 7L, 'end', 9L))")
    df = spark.createDataFrame([("éb345x7890",), (None,)], "text string")
    got = [r[0] for r in df.select(secrets.mask_spans(F.col("text"), spans)).collect()]
    assert got == ["éb[SECRET]x7[SECRET]0", None]


def test_language_backs_off(spark):
    rows = [("the house is near the water", "en")] * 5 + [("das haus ist nahe am wasser", "de")] * 5 + [(None, "fr"), ("x", None)]
    model = language.learn(spark.createDataFrame(rows, "text string, lang string"))
    asked = spark.createDataFrame([(1, "the water"), (2, "wassers"), (3, None), (4, "12 !"), (5, "жж"), (6, "")], "doc_id long, text string")
    got = {k: (v[0]["lang_pred"], v[0]["score"]) for k, v in by_id(language.identify(asked, model)).items()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[5][0] == "de"
    assert got[3] == got[4] == got[6] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())


def test_mix_meets_targets(docs):
    rows = mixing.mix_sources(docs, block_words=16, shard_slots=8).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
        assert r["taken"] == sum(p["n"] for p in r["pieces"] or [])
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    want, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while True:
        share = left / sum(weight[s] for s in open_)
        stopped = {s for s in open_ if share * weight[s] > 2 * sizes[s]}
        if not stopped:
            break
        for s in stopped:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
        open_ -= stopped
    want |= {s: share * weight[s] for s in open_}
    assert target == pytest.approx(want)
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in names)
    again = mixing.mix_sources(docs.repartition(3), block_words=16, shard_slots=8).collect()
    assert Counter(map(str, rows)) == Counter(map(str, again))


def test_mixed_texts_hold_the_taken_words(docs):
    taken = sum(r["taken"] for r in mixing.mix_sources(docs).collect())
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(words(r["text"])) for r in mixed.collect()) == taken


def test_mixed_texts_are_spans_in_document_order(spark):
    """Ten blocks a text, a source that is taken less than once and one taken more than once."""
    draw = random.Random(9)
    texts = ["  \n" * (i % 2) + "".join(f"w{i}x{k}{draw.choice([' ', chr(9), chr(10), chr(10) + '    '])}" for k in range(80)) for i in range(12)]
    rows = [(i, t, "en", "ab"[i % 4 == 0], len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    pieces = {r["doc_id"]: r["pieces"] for r in mixing.mix_sources(df, block_words=8, shard_slots=4).collect()}
    whole = several = 0
    for r in mixing.mixed_documents(df, block_words=8, shard_slots=4).collect():
        text, taken = texts[r["doc_id"]], pieces[r["doc_id"]]
        starts = [text.index(w + text[text.index(w) + len(w)]) for w in text.split()] + [len(text)]
        starts[0] = 0
        want = ["".join(text[starts[p["first"]] : starts[p["first"] + p["n"]]] for p in sorted(taken, key=lambda p: p["first"]) if p["turn"] == turn) for turn in sorted({p["turn"] for p in taken})]
        assert r["text"] == "\n".join(want) and r["n_chars"] == len(r["text"])
        whole += text in r["text"]
        several += len(want) > 1
    assert whole and several


def test_permutation_is_one():
    for n in (1, 2, 3, 100, 257):
        assert sorted(mixing.permute(np.arange(n), n, 5)) == list(range(n))


def test_repeats_against_brute_force(docs):
    rows = corpus()
    first = {}
    order = lambda i: (1 << 63) if i is None else i
    for i, text, *_ in sorted(rows, key=lambda r: order(r[0])):
        w = words(text)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), order(i))
    want = Counter()
    for i, text, *_ in rows:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < order(i):
                gone[k : k + 13] = [True] * 13
        want[i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()] += 1
    assert Counter(map(tuple, recompression.remove_repeats(docs).collect())) == want
    assert sum(k[2] for k in want) > 500


def test_windows_share_anchors():
    assert recompression.guaranteed(13, 1, 6, 3) and not recompression.guaranteed(13, 1, 7, 3)
    rng = np.random.default_rng(1)
    for _ in range(300):
        alphabet = rng.integers(0, 1 << 62, rng.choice([2, 5, 50])).astype(np.uint64)
        window = rng.choice(alphabet, 13)
        keys = []
        for _ in range(2):
            text = np.concatenate([rng.choice(alphabet, rng.integers(0, 9)), window, rng.choice(alphabet, rng.integers(0, 9))])
            keys.append(set(recompression.anchors(text, np.array([0, len(text)]))[3].tolist()))
        assert keys[0] & keys[1]


def test_quality_learns(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["good", "clear", "plain"]) if i % 2 else rng.choice(["$$$", "spam!!", "buy"]) for _ in range(40)), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = df.select("doc_id", "quality")
    model = quality.learn(quality.training_rows(df, labels, "doc_id % 5 <> 0"))
    got = by_id(quality.score(df.select("doc_id", "text"), model))
    held = [r for r in rows if r[0] % 5 == 0]
    assert sum(got[i][0]["predicted"] == q for i, _, q in held) / len(held) > 0.95


def test_line_rules_counts(docs):
    got = by_id(line_rules.apply_line_rules(docs))
    for i, text, *_ in corpus():
        w = words(text)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        r = got[i][0] if i is not None else next(x for x in got[i] if x["n_words"] == len(w))
        assert (r["n_words"], r["n_repeat_words"]) == (len(w), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_lines_go_and_clean_documents_stay():
    prose = "\n".join(f"Sentence{i} says{i} one{i} more{i} plain{i} thing{i}." for i in range(20))
    clean = line_rules.judge(prose)
    assert clean["kept"] and clean["clean_text"] == prose
    some = line_rules.judge(prose + "\nHome | News | About | Login\nAll rights reserved.\n" + prose.split("\n")[0])
    assert some["kept"] and some["clean_text"] == prose and some["n_dup_lines"] == 1
    assert not line_rules.judge("\n".join("Go! | %s | *** | ##" % i for i in range(60)) + "\n" + prose)["kept"]


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    vectors = [b + rng.normal(size=16) * s for b in base for s in (0, 0.05, 0.1, 0.15)] + [base[0]] * 300 + [base[1] * 3]
    vectors += [base[2] + rng.normal(size=16) * 0.01 for _ in range(1500)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    rows += [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [None] * 16), (9004, []), (9005, rows[0][1][:8])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit(1))
    u = np.array([r[1] for r in rows[: len(vectors)]])
    u /= np.linalg.norm(u, axis=1)[:, None]
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    want = components(range(len(u)), np.argwhere(np.triu(link)).tolist())
    got = {r["vec_id"]: r for r in forest.near_vectors(df).collect()}
    assert len(got) == len(rows)
    found = sum(got[i]["n_links"] for i in range(len(u))) / link.sum()
    assert 0.999 <= found <= 1 and all(got[i]["n_links"] <= link[i].sum() for i in range(len(u)))
    assert sum(got[i]["component_id"] == want[i] for i in range(len(u))) >= 0.999 * len(u)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(9000, 9006))
    assert forest.near_vectors(df.limit(0)).count() == 0


def test_deep_forests_find_barely_linked_pairs():
    """Vectors spread evenly, pairs at the threshold, trees of 10 levels and more."""
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    trees = forest.grow(unit(rng.normal(size=(40_000, 32))), 11, forest.TREES)
    assert min(t.levels for t in trees) >= 10
    a = unit(rng.normal(size=(5000, 32)))
    across = rng.normal(size=a.shape)
    across = unit(across - (across * a).sum(axis=1, keepdims=True) * a)
    b = forest.COSINE * a + np.sqrt(1 - forest.COSINE**2) * across
    met = np.zeros(len(a), bool)
    for tree in trees:
        of = dict(tree.leaves(a))
        for leaf, rows in tree.leaves(b):
            met[np.intersect1d(rows, of.get(leaf, rows[:0]))] = True
    print(len(trees), trees[0].levels, 1 - met.mean())
    assert 1 - met.mean() <= forest.MISSED


def test_shards_are_even_and_groups_whole(docs):
    rows = sharding.shard_documents(docs).collect()
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(8))
    for s, n in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    groups = defaultdict(list)
    for r in rows:
        groups[r["text_crc32"], r["size"]].append(r["shard"])
    several = [g for g in groups.values() if len(g) > 1]
    # only the hot group outgrows a shard
    assert sum(len(set(g)) > 1 for g in several) <= 2


def test_near_duplicates_against_brute_force(docs):
    sets = {}
    for i, text, *_ in corpus():
        w = (text or "").encode().lower().split()
        if i is not None:
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    links = [
        (a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    want = components(ids, links)
    got = by_id(setsketch.near_duplicates(docs))
    for i in ids:
        for r in got[i]:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), want[i], want[i] == i)
    assert all(r["component_id"] is None and r["kept"] for r in got[None])


def test_texts_of_one_doc_id_keep_their_own_links(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(5, a), (5, b), (7, a + " tail"), (8, b + " tail"), (3, b + " end"), (9, a), (9, a.upper() + " more")]
    got = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).join(
        spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
        .select("doc_id", F.xxhash64("text").alias("text_hash"), "n"), ["doc_id", "text_hash"]
    )
    got = {r["n"]: (r["component_id"], r["kept"]) for r in got.collect()}
    assert got == {0: (5, True), 1: (3, False), 2: (5, False), 3: (3, False), 4: (3, True), 5: (5, False), 6: (5, False)}


def test_near_copies_over_many_blocks(spark, monkeypatch):
    """Two families that reach over many blocks, and members too far from all others."""
    monkeypatch.setattr(setsketch, "BLOCK", 8)
    draw, rows = random.Random(5), []
    for family in range(2):
        base = [f"w{family}x{k}" for k in range(200)]
        for _ in range(45):
            words = list(base)
            for k in draw.sample(range(200), draw.choice((1, 3, 6, 8, 12))):
                words[k] = f"n{draw.random()}"
            rows.append((len(rows), " ".join(words)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(196)} for _, t in rows]
    links = [(a, b) for a in range(90) for b in range(a + 1, 90) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(range(90), links)
    assert 2 < len(set(want.values())) < 90
    got = by_id(setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: got[i][0]["component_id"] for i in range(90)} == want


def test_intersections_in_slices(monkeypatch):
    monkeypatch.setattr(setsketch, "COLUMNS", 3)
    sets = [np.array(sorted(s), np.uint64) for s in ({1, 2, 3, 9}, {2, 3, 4, 5, 9}, {7}, {1, 2, 3, 4, 5, 9})]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    got = setsketch.intersections(sets)
    # alone in its set, a shingle is in no product: the diagonal is not used
    assert all(got[i, j] == want[i][j] for i in range(4) for j in range(4) if i != j)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    a, b = x[:3000], x[1000:]
    ra, rb = setsketch.registers(a), setsketch.registers(b)
    assert (setsketch.merge(ra, rb) == setsketch.registers(x)).all()
    assert setsketch.estimate(ra[None], rb[None], np.array([3000.0]), np.array([3000.0]))[0] == pytest.approx(0.5, abs=0.15)


def test_bpe_like_tiktoken(docs):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.round_trip(docs, RANKS, PATTERN))
    for i, text, *_ in corpus():
        if i is not None:
            ids = own.encode_ordinary(text or "")
            r = got[i][0]
            assert r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    encoded = bpe.encode(docs, RANKS, PATTERN)
    back = bpe.decode(encoded, RANKS, PATTERN).collect()
    assert Counter(bytes(r["data"]).decode() for r in back) == Counter(r[1] or "" for r in corpus())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf):
    db = duckdb.connect()
    for t in SCHEMAS:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    found = table(df.columns, [tuple(r) for r in df.collect()])
    cur = db.execute(ORACLES[name])
    assert found == table([c[0] for c in cur.description], cur.fetchall())


def terms_of(text):
    return [w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())]


def test_crcs_by_position():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 300_000).astype(np.uint8)
    sizes = np.array([1, 2, 63, 64, 65, 127, 128, 129, 192, 193, 1000, 4097, 100_001])
    starts = rng.integers(0, 100_000, len(sizes))
    want = [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(starts, sizes)]
    assert importance.span_crcs(data, starts, starts + sizes).tolist() == want


@pytest.mark.parametrize("longest", [1, 3])
def test_resample_like_plain_python(docs, spark, longest):
    aim = spark.createDataFrame([("The the é w1 w2",), ("w3 p1 p2 P3",), (None,), ("",)], "text string")
    got = importance.resample(docs, aim, share=25, buckets=97, longest=longest).collect()

    def runs_of(text):
        w = terms_of(text)
        return [b" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    rows = corpus()
    s, t = Counter(), Counter()
    for r in rows:
        s.update(zlib.crc32(f) % 97 for f in runs_of(r[1]))
    for text in ("The the é w1 w2", "w3 p1 p2 P3"):
        t.update(zlib.crc32(f) % 97 for f in runs_of(text))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 97) / ((s[b] + 1) * (T + 97)))) for b in range(97)]
    want = []
    for r in rows:
        f = runs_of(r[1])
        weight = sum(gain[zlib.crc32(x) % 97] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        want.append((r[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(terms_of(r[1])) >= 20))
    order = sorted((w for w in want if w[4]), key=lambda w: (-w[3], w[0] is None, w[0] or 0))
    drawn = 25 * len(order) // 100
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == Counter(w[:4] for w in want)
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, drawn + 1))
    assert [(r["doc_id"], r["score"]) for r in ranked] == [(w[0], w[3]) for w in order[:drawn]]


def test_resample_without_target_or_documents(docs, empty, spark):
    none = spark.createDataFrame([], "text string")
    assert sum(r["rank"] is not None for r in importance.resample(docs, none).collect()) > 0
    assert importance.resample(empty, none).count() == 0
    short = spark.createDataFrame([(1, "few words"), (None, None)], "doc_id long, text string")
    assert [r["rank"] for r in importance.resample(short, none).collect()] == [None, None]


def plain_ranking(rows, items, k):
    """Scores of the contract by counting, for documents (doc_id, text) and items (item_id, text)."""
    held = [(i, Counter(terms_of(t))) for i, t in rows]
    held = [(i, c, c.total()) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = Counter()
    for item, text in set(items):
        asked = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(terms_of(text))}
        scored = []
        for i, c, n in held:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t, w in asked.items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1):
            out[(item, rank, i, -score)] += 1
    return out


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_ranking_like_plain_python(docs, spark, monkeypatch, block):
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", block)
    monkeypatch.setattr(ranked_search, "ITEM_BYTES", 200)
    monkeypatch.setattr(ranked_search, "FIRST_RANGES", 2)
    monkeypatch.setattr(ranked_search, "NEXT_RANGES", 5)
    items = [(i, t) for i, t, *_ in corpus()[:9]] + [(1, "THE é w1 w1"), (1, "THE é w1 w1"), (1, "w2"), (None, "p1 p2 word x"), (7, None), (8, "- ."), (9, "unknown")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("clash") for c in ("doc_id", "rank", "score", "item")})
    got = ranked_search.rank_documents(docs, asked, 12).collect()
    assert Counter(tuple(r) for r in got) == plain_ranking([(r[0], r[1]) for r in corpus()], items, 12)


def test_ranking_depth_first_and_empty(docs, empty, spark, monkeypatch):
    items = [(1, "the w1 w2 w3 w4"), (2, "p1 the")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(ranked_search, "OPEN_NUMBERS", 0)
    got = ranked_search.rank_documents(docs, asked).collect()
    assert Counter(tuple(r) for r in got) == plain_ranking([(r[0], r[1]) for r in corpus()], items, 50)
    assert ranked_search.rank_documents(empty, asked).count() == ranked_search.rank_documents(docs, asked.limit(0)).count() == 0


def test_treap_keeps_every_cell():
    rng = np.random.default_rng(1)
    for rows, columns, n in ((1, 1, 1), (1, 50, 20), (40, 3, 60), (200, 300, 5000)):
        cell = np.unique(rng.integers(0, rows * columns, n))
        r, c = np.divmod(cell, columns)
        value = rng.integers(1, 1000, len(cell))
        treap = ranked_search.Treap(*ranked_search.build_treap(r, c, value))
        for row in range(rows):
            best = ranked_search.Best(columns)
            ranked_search.descend(treap, np.array([row]), np.array([1]), np.arange(1 << treap.height), np.zeros(1 << treap.height, bool), best)
            assert dict(zip(best.ids.tolist(), best.scores.tolist())) == {int(x): int(v) for x, v in zip(c[r == row], value[r == row])}


TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def plain_ids(texts):
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


@pytest.mark.parametrize("cached", [50, 1 << 20])
def test_units_encode_like_whole_texts(monkeypatch, cached):
    monkeypatch.setattr(token_files, "CACHE_UNITS", cached)
    draw = random.Random(1)
    marks = [".", ",", "a.", "b,", " a.", "é."] + list("ab1'.!# \t\n\r  \u0085 　​\x1c\x00\x7féж中٣²Ⅷ") + ["  ", " \n", "\n ", "\n\n", "\na", " 's", "'ll", "<|endoftext|>", " é", " ٣"]
    texts = ["".join(draw.choice(marks) for _ in range(draw.randint(0, 14))) for _ in range(4000)] + [None, " " * 3000 + "y", "x" * 50_000]
    own = token_files.Encoder(TOKENIZER)
    portions = [texts[i : i + 40] for i in range(0, len(texts), 40)] * 2
    got = [np.frombuffer(x, "<u2").tolist() + [2] for p in portions for x in own.encode(p)]
    assert got == plain_ids(texts) * 2


@pytest.mark.parametrize("shard_bytes", [1 << 10, 1 << 30])
def test_token_files_round_trip(docs, spark, shard_bytes):
    store = token_files.write_store(docs, TOKENIZER, 2, shard_bytes)
    got = sorted(token_files.read_store(store, with_ids=True).collect(), key=lambda r: r["start"])
    want = Counter((r[0], tuple(ids)) for r, ids in zip(corpus(), plain_ids([r[1] for r in corpus()])))
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert order == sorted(order)
    again = token_files.read_store(token_files.write_store(docs.repartition(3), TOKENIZER, 2, shard_bytes)).collect()
    assert Counter(map(tuple, again)) == Counter((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got)


def test_token_files_short_access_and_wrong_dictionary(docs, empty, spark):
    store = token_files.write_store(docs.filter("doc_id < 9000"), TOKENIZER)
    assert len(store.dictionary) > 0
    first = store.files.orderBy("shard").first()
    assert token_files.lookup(store, spark, first["shard"], 0).tolist() == plain_ids([corpus()[0][1]])[0]
    other = token_files.Store(store.folder, store.dictionary + b"x", store.files)
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.lookup(other, spark, first["shard"], 0)
    nothing = token_files.write_store(empty, TOKENIZER)
    assert nothing.files.count() == token_files.read_store(nothing).count() == 0


def test_vectors_without_or_with_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [1.0, 0.01]), (None, [0.0, 1.0]), (2, [1.0, 0.02]), (None, [-1.0, 0.0]), (None, None), (3, None), (3, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("node", "key", "least", "component")})
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in forest.near_vectors(df).collect())
    assert got == Counter([
        (1, 3, 1, True), (1, 3, 1, True), (1, 1, 1, True), (None, 3, 1, False), (None, 1, 1, False), (2, 3, 1, False),
        (None, 0, None, True), (None, 0, None, True), (3, 0, 3, True), (3, 0, 3, True),
    ])


def test_forest_samples_by_hash_alone(spark, monkeypatch):
    """About as many vectors as asked for, and the same ones however the table is dealt out."""
    monkeypatch.setattr(forest, "SAMPLE_VALUES", 400)
    sizes, grow = [], forest.grow
    monkeypatch.setattr(forest, "grow", lambda sample, *a: sizes.append(len(sample)) or grow(sample, *a))
    draw = np.random.default_rng(4)
    rows = [(hashlib.md5(bytes([i % 256, i // 256])).digest(), v.tobytes()) for i, v in enumerate(draw.normal(size=(4000, 4)))]
    df = spark.createDataFrame(rows, "key binary, unit binary")
    first, again = (forest.fit(df.repartition(n), 4000, 4, 3) for n in (2, 5))
    assert 60 < sizes[0] == sizes[1] < 140
    for a, b in zip(first, again, strict=True):
        assert a.splits.keys() == b.splits.keys()
        assert all(x[1] == y[1] and (x[0] == y[0]).all() for x, y in ((a.splits[k], b.splits[k]) for k in a.splits))


@pytest.mark.parametrize("sizes, alone", [([100] * 16, 0), ([100] * 24, 0), ([20] * 200, 0), ([50] * 36, 200), ([50] * 20, 1000), ([900, *[3] * 400], 300), ([2] * 300, 3)])
def test_shards_split_one_group_a_border(spark, sizes, alone):
    """Tables of which all, 90 % or half the rows are linked: even counts, and groups whole but for borders."""
    texts = [f"group {g}" for g, n in enumerate(sizes) for _ in range(n)] + [f"alone {i}" for i in range(alone)]
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 8
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    held = defaultdict(set)
    text = dict(rows)
    for r in got:
        held[text[r["doc_id"]]].add(r["shard"])
    per_shard = -(-len(rows) // 8)
    # every border lies in one group at most; a group that outgrows a shard holds several borders
    assert sum(len(s) - 1 for s in held.values()) <= 7
    for g, n in enumerate(sizes):
        assert len(held[f"group {g}"]) <= 2 + n // per_shard


def test_labels_that_are_no_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, -1), (4, None), (None, 1), (5, 1), (5, 0)], "doc_id long, quality int")
    rows = quality.training_rows(docs, labels, "true").collect()
    assert {(r["doc_id"], r["quality"]) for r in rows} == {(0, 0), (1, 1), (5, 0)}


def test_scores_like_plain_loops(spark):
    """The trained model's forward pass, feature by feature, in double precision."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["clean", "prose", "spam", "buy", "naïve", "x" * 40]) for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["", None]
    rows = [(i, t, int("spam" not in (t or ""))) for i, t in enumerate(texts)]
    model = quality.learn(spark.createDataFrame(rows, "doc_id long, text string, quality int"))
    found, first = quality.features(pa.array(texts, pa.string()))
    got = {r["doc_id"]: r["score"] for r in quality.score(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), model).collect()}
    for i in range(len(texts)):
        own = found[first[i] : first[i + 1]].tolist()
        mean = [sum(float(model.table[f, k]) for f in own) / len(own) for k in range(model.table.shape[1])]
        logit = [sum(mean[k] * float(model.output[k, c]) for k in range(len(mean))) + float(model.bias[c]) for c in (0, 1)]
        assert got[i] == pytest.approx(1 / (1 + math.exp(logit[0] - logit[1])), abs=1e-5)


def test_token_caches_stay_small():
    own = token_files.Encoder(TOKENIZER)
    for start in range(0, 500_000, 20_000):
        own.encode([" ".join([f"w{i}", *(f"x{n}" for n in range(i, i + 20))]) for i in range(start, start + 20_000, 20)])
    held = sum(sys.getsizeof(c) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in c.items()) for c in (own.inner, own.first))
    assert held < 50e6


def test_token_units_met_once_are_not_held_and_frequent_ones_stay(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_UNITS", 400)
    own = token_files.Encoder(TOKENIZER)
    learned = Counter()
    learn = own.learn
    own.learn = lambda units: learned.update(units) or learn(units)
    texts = [" ".join(["Often", "often", "common.", *(f"once{i}x{n}" for n in range(20)), *(f"twice{i // 2}y{n}" for n in range(20))]) for i in range(100)]
    plain = own.tokenizer.encode_batch(texts, add_special_tokens=False)
    for text, ids in zip(texts, plain):
        assert np.frombuffer(own.encode([text])[0], f"<u{own.width}").tolist() == ids.ids
    assert learned["often"] <= 3 and learned["common"] <= 3
    held = own.inner.keys() | own.older.keys()
    assert not any(u and u.startswith("once99") for u in held) and len(held) <= 450


def test_a_call_costs_its_own_units_not_those_held():
    """F op13: each batch, and each text with a part that starts no unit, went through all units that were held."""
    own = token_files.Encoder(TOKENIZER)

    def seconds():
        start = time.process_time()
        for i in range(60):
            own.encode([f"a new{i} word{i}", f"double  space{i}"])
        return time.process_time() - start

    empty = seconds()
    own.inner |= {f"held{i}": b"xx" for i in range(500_000)}
    assert seconds() < 10 * empty + 0.2


def test_token_units_are_cut_from_the_column_without_their_marks():
    """F op13: every unit of every text was a Python string of its own, and a word with a mark was a unit of its own."""
    own = token_files.Encoder(TOKENIZER)
    learned = []
    learn = own.learn
    own.learn = lambda units: learned.extend(units) or learn(units)
    texts = ["gone", "A stop. stop, stop; stop!\nstop? (stop) it's: x. ", None, "", ".", "é stop.", ". éa 中. 2) a\n", " 😀 a.b. \n\nstop.\n ", "stop."]
    got = own.encode(pa.array(texts, pa.string())[1:])
    assert [np.frombuffer(x, f"<u{own.width}").tolist() + [2] for x in got] == plain_ids(texts[1:])
    assert learned.count("stop") == 1 and not {"stop.", "stop,", "stop;", "stop!"} & {*learned, *own.inner}
    assert own.encode(texts[1:]) == got and own.encode([]) == []
