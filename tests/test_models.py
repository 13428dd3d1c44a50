"""Operators against independent plain-Python models on random input."""

import datetime as dt
import random
import re
import tracemalloc
from collections import deque

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom.functions import chunking as ck
from docloom.functions import text as tx
from docloom.functions.embedding import PART_BYTES, HashingEmbedder, adjacent_similarity, embed
from docloom.operators import aggregates as ag, dedup, skew, vectors as vc, windows as wn
from docloom.plans import ingest as ing, quality
from docloom.streaming import events as ev, limits as lm


def random_texts(n, seed):
    rng = random.Random(seed)
    bits = ["word", "a", "Longer", "é", "x" * 40, ".", "!", "?", " ", "  ", "\n", "\n\n", "\n\n\n", "\t", " "]
    return [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 120))) for _ in range(n)] + ["", " ", "\n\n"]


def model_sentence(text, size):
    out, cur, used = [], [], 0
    for piece in re.split(r"(?<=[.!?]) +", text.strip()):
        if used + len(piece) > size:
            out += [" ".join(cur)] if cur else []
            cur, used = [piece], len(piece)
        else:
            cur, used = cur + [piece], used + len(piece) + 1
    return out + ([" ".join(cur)] if cur else [])


def model_paragraph(text, size):
    out, cur, used = [], [], 0
    for piece in filter(None, (p.strip() for p in text.split("\n\n"))):
        if used + len(piece) > size:
            out += ["\n\n".join(cur)] if cur else []
            if len(piece) > size:
                out, cur, used = out + model_sentence(piece, size), [], 0
            else:
                cur, used = [piece], len(piece)
        else:
            cur, used = cur + [piece], used + len(piece) + 2
    return out + (["\n\n".join(cur)] if cur else [])


@pytest.mark.parametrize("size", [20, 64, 300])
def test_chunk_strategies(spark, size):
    texts = random_texts(150, size)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", *[ck.chunk(F.col("t"), s, size).alias(s) for s in ("fixed", "sentence", "paragraph")]
    ).collect()
    for r in rows:
        t = r["t"]
        assert r["fixed"] == [t[i : i + size] for i in range(0, len(t), size)]
        assert r["sentence"] == (model_sentence(t, size) if t else [])
        assert r["paragraph"] == (model_paragraph(t, size) if t else [])


def model_semantic(text, max_size, min_size, overlap):
    sents = [
        s.strip() for p in re.split(r"\n\n+", text.strip()) if p.strip()
        for s in re.split(r"(?<=[.!?])\s+", p.strip()) if s.strip()
    ]
    if not sents:
        return []
    m = HashingEmbedder()(sents)
    norm = np.sqrt((m * m).sum(axis=1))
    sims = [round(float((m[i] * m[i + 1]).sum() / (norm[i] * norm[i + 1])), 9) for i in range(len(sents) - 1)]
    limit = round(float(max(0.1, min(0.9, np.percentile(sims, 25)))), 9) if sims else 0.75
    groups, cur = [], sents[0]
    for s, sim in zip(sents[1:], sims):
        if len(cur) >= min_size and (sim < limit or len(cur) + len(s) + 2 > max_size):
            groups.append(cur)
            cur = s
        else:
            cur += " " + s
    groups.append(cur)
    kept = [g for g in groups if len(g) >= min_size]
    if not kept:
        return groups
    return [g if i == 0 else " ".join(kept[i - 1].split()[-overlap:]) + " " + g for i, g in enumerate(kept)]


def test_semantic_chunker(spark):
    texts = random_texts(120, 5)
    df = spark.createDataFrame(list(enumerate(texts)), "document_id long, text string")
    rows = ing.semantic_chunks(F.col("text"), max_size=200, min_size=30, overlap_words=5)(df).collect()
    for r in rows:
        assert r["chunks"] == model_semantic(r["text"], 200, 30, 5)


def test_similarities_do_not_depend_on_block_size(spark):
    df = spark.createDataFrame([([f"w{i % 7} w{i % 3} common" for i in range(50)],)], "s array<string>")
    a, b = [df.select(adjacent_similarity(F.col("s"), batch=n)).first()[0] for n in (4, 100)]
    assert a == b and len(a) == 49


def random_events(n, users, seed, spread=4000):
    rng = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        # a third of all rows belong to user 0
        user = 0 if rng.random() < 0.34 else rng.randint(1, users)
        rows.append((i, base + dt.timedelta(seconds=rng.choice([0, 0, 20000, 90000]) + rng.randint(0, spread), microseconds=rng.randint(0, 999999)),
                     user, f"p{rng.choice([0, 0, 0, 1, 2])}", rng.random() * 200))
    return rows


@pytest.mark.parametrize("user_limit,project_limit", [(3, 1000), (1000, 9), (3, 9), (1, 2), (50, 500)])
def test_upload_limits(spark, user_limit, project_limit):
    rows = random_events(500, 12, user_limit * 1000 + project_limit)
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, project_id string, value double").repartition(5)
    got = {r["event_id"]: r["reason"] for r in lm.upload_limits(df, user_limit, project_limit, 60).collect()}
    users, projects, want = {}, {}, {}
    for i, ts, u, p, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        recent = lambda d, k: [t for t in d.get(k, []) if t > ts - dt.timedelta(seconds=60)]  # noqa: E731, B023
        mine, ours = recent(users, u), recent(projects, p)
        want[i] = "user" if len(mine) >= user_limit else "project" if len(ours) >= project_limit else ""
        if not want[i]:
            mine, ours = mine + [ts], ours + [ts]
        users[u], projects[p] = mine, ours
    assert got == want


@pytest.mark.parametrize("limits", [(1, 4, 20), (3, 2, 500), (50, 50, 9)])
def test_chat_limits(spark, limits):
    concurrent, minute, day = limits
    rows = random_events(400, 6, sum(limits))
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, p string, duration_s double").repartition(3)
    got = {r["event_id"]: r["reason"] for r in lm.chat_limits(df, concurrent, minute, day).collect()}
    state, want = {}, {}
    for i, ts, u, _, dur in sorted(rows, key=lambda r: (r[1], r[0])):
        us = round(ts.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
        runs = state.setdefault(u, [])
        active = sum(e > us for _, e in runs)
        in_minute = sum(s > us - 60_000_000 for s, _ in runs)
        in_day = sum(s > us - 86_400_000_000 for s, _ in runs)
        want[i] = "concurrent" if active >= concurrent else "minute" if in_minute >= minute else "day" if in_day >= day else ""
        if not want[i]:
            runs.append((us, us + int(min(dur, 120.0) * 1_000_000)))
    assert got == want


def unit_vectors(n, dim, seed):
    m = np.random.default_rng(seed).standard_normal((n, dim))
    # copies of one vector make up a third of the table
    m[: n // 3] = m[0]
    return m


def frame(spark, m, key, tenants=None):
    rows = [(i, v.tolist(), *( [tenants[i]] if tenants else [])) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, f"{key} long, vector array<double>" + (", project_id string" if tenants else ""))


def brute(q, c, k, low, qt=None, ct=None):
    out = set()
    for i, a in enumerate(q):
        s = np.round((c @ a) / (np.linalg.norm(c, axis=1) * np.linalg.norm(a)), 6)
        rows = [(-s[j], j) for j in range(len(c)) if s[j] >= low and (qt is None or qt[i] == ct[j])]
        out |= {(i, j, r + 1) for r, (_, j) in enumerate(sorted(rows)[:k])}
    return out


@pytest.mark.parametrize("tenant", [False, True])
@pytest.mark.parametrize("max_broadcast", [1000, 3])
def test_topk_both_ways(spark, tenant, max_broadcast):
    q, c = unit_vectors(11, 8, 1), unit_vectors(300, 8, 2)
    qt = [f"t{i % 3}" for i in range(len(q))] if tenant else None
    ct = [f"t{i % 3}" for i in range(len(c))] if tenant else None
    got = vc.topk_cosine(
        frame(spark, q, "query_id", qt), frame(spark, c, "id", ct).repartition(7), 5, 0.1,
        same="project_id" if tenant else None, max_broadcast=max_broadcast,
    ).collect()
    assert {(r["query_id"], r["id"], r["rank"]) for r in got} == brute(q, c, 5, 0.1, qt, ct)


def test_topk_in_small_blocks(spark, monkeypatch):
    q, c = unit_vectors(5, 8, 3), unit_vectors(200, 8, 4)
    import pandas as pd

    monkeypatch.setattr(vc, "MAX_CELLS", 35)
    pdf = pd.DataFrame({"id": range(200), "vector": list(c)})
    qdf = pd.DataFrame({"query_id": range(5), "vector": list(q)})
    part = vc._best(pdf, qdf, None, 4, -1.0)
    best = part.sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id").head(4)
    assert {(a, b) for a, b in zip(best["query_id"], best["id"])} == {(i, j) for i, j, _ in brute(q, c, 4, -1.0)}


def test_topk_skips_null_vectors(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "id long, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, vector array<double>")
    assert [(r["query_id"], r["id"]) for r in vc.topk_cosine(q, c, 5, -1.0).collect()] == [(1, 1)]


def test_approximate_recall(spark):
    rng = np.random.default_rng(9)
    c = rng.standard_normal((400, 16))
    q = c[:30] + 0.15 * rng.standard_normal((30, 16))
    args = frame(spark, q, "query_id"), frame(spark, c, "id")
    found = {(r["query_id"], r["id"]) for r in vc.approx_topk(*args, dim=16, k=1, block_rows=40).collect()}
    exact = {(i, j) for i, j, _ in brute(q, c, 1, -1.0)}
    assert len(found & exact) >= 0.9 * len(exact)
    scores = {(r["query_id"], r["id"]): r["score"] for r in vc.topk_cosine(*args, k=400, min_score=-1.0).collect()}
    assert all(f in scores for f in found)


def test_deep_search_model(spark):
    q, c = unit_vectors(4, 8, 5), unit_vectors(90, 8, 6)
    got = vc.deep_search(frame(spark, q, "query_id"), frame(spark, c, "id"), 3, 4).collect()
    want = {}
    for i, a in enumerate(q):
        cur = a
        for hop in range(3):
            hits = [(j, r) for x, j, r in brute([cur], c, 4, 0.0)]
            for j, r in hits:
                want.setdefault((i, j), hop)
            if not hits:
                break
            cur = cur + 0.5 * c[[j for j, _ in hits]].mean(axis=0)
    assert {(r["query_id"], r["id"]): r["hop"] for r in got} == want


def test_kmeans_model(spark):
    m = unit_vectors(120, 4, 7)
    init = [m[0], m[50], m[51], np.full(4, 99.0)]
    df = frame(spark, m, "id").repartition(5)
    got = {r["id"]: r["cluster"] for r in vc.cluster(df, "vector", 4, init=[list(map(float, v)) for v in init]).collect()}
    cents = np.array(init)
    for _ in range(10):
        who = ((m[:, None, :] - cents[None]) ** 2).sum(axis=2).argmin(axis=1)
        cents = np.array([m[who == j].mean(axis=0) if (who == j).any() else cents[j] for j in range(4)])
    assert got == dict(enumerate(who))


def test_context_skips_and_goes_on(spark):
    rng = random.Random(3)
    rows = [(s, i, rng.choice(["user", "assistant"]), "x" * rng.randint(0, 40)) for s in range(5) for i in range(60)]
    df = spark.createDataFrame(rows, "session_id long, seq long, role string, content string")
    got = {(r["session_id"], r["seq"]) for r in wn.context(df, budget=200).collect()}
    want = set()
    for s in range(5):
        used = 0
        for _, i, _, text in [r for r in rows if r[0] == s][-30:]:
            if used + len(text) <= 200:
                used += len(text)
                want.add((s, i))
    assert got == want


def test_attach_with_hot_key(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i}" if i % 7 else None) for i in range(4000)]
    big = spark.createDataFrame(rows, "id long, key string")
    per_key = big.filter("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    got = {r["id"]: (r["n"], r["first"]) for r in skew.attach(big, per_key, "key", "n", ["id"]).collect()}
    count = {}
    for i, k in rows:
        if k is not None:
            count.setdefault(k, []).append(i)
    assert got == {i: (len(count[k]), count[k][0]) if k is not None else (None, None) for i, k in rows}


def test_running_sum(spark):
    rng = random.Random(1)
    rows = [(0 if rng.random() < 0.4 else rng.randint(1, 5), rng.randint(0, 500), i, rng.choice([1, -1])) for i in range(900)]
    df = spark.createDataFrame(rows, "k long, t long, i long, v long")
    got = {r["i"]: r["s"] for r in skew.running_sum(df, ["k"], ["t", "i"], "v", "s", F.floor(F.col("t") / 50)).collect()}
    want, total = {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        total[k] = total.get(k, 0) + v
        want[i] = total[k]
    assert got == want


def test_operators_do_not_depend_on_partitions(spark):
    rows = [(i, f"h{i % 13}", i % 5) for i in range(500)]
    out = []
    for n in (1, 8):
        df = spark.createDataFrame(rows, "document_id long, chunk_hash string, chunk_index long").repartition(n)
        out.append(sorted(map(tuple, dedup.dedup_chunks(df).collect())))
    assert out[0] == out[1]


def test_window_counts_cross_block_edges(spark):
    rows = random_events(300, 3, 8)
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, p string, v double")
    got = {r["event_id"]: r["n"] for r in lm.window_counts(lm.with_micros(df), "user_id", 60, "n").collect()}
    for i, ts, u, _, _ in rows:
        assert got[i] == sum(1 for r in rows if r[2] == u and ts - dt.timedelta(seconds=60) < r[1] <= ts)


def test_squeeze_matches_python_split(spark):
    texts = random_texts(100, 11) + ["\x1ca\x85b c　d "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", tx.summarize(F.col("t"), 30).alias("s"), tx.strip(F.col("t")).alias("z"), tx.words(F.col("t")).alias("w")
    ).collect()
    for r in rows:
        flat = " ".join(r["t"].split())
        assert r["s"] == (flat if len(flat) <= 30 else flat[:30] + "...")
        assert r["z"] == r["t"].strip() and r["w"] == r["t"].split()


def test_active_runs_model(spark):
    rows = random_events(300, 4, 21)
    df = spark.createDataFrame([(r[0], r[1], r[2], r[4]) for r in rows], "run_id long, ts timestamp, user_id long, duration_s double")
    got = {(r["run_id"], r["step"]): r["active"] for r in ev.active_runs(df).collect()}
    moves = []
    for i, ts, u, _, dur in rows:
        us = round(ts.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
        moves += [(us, 1, i, u), (us + int(min(dur, 120.0) * 1_000_000), -1, i, u)]
    total = {}
    for at, step, i, u in sorted(moves):
        total[u] = total.get(u, 0) + step
        assert got[(i, step)] == total[u]


def test_deque_trim():
    w = deque([1, 5, 9])
    lm._trim(w, 5)
    assert list(w) == [9]


def test_clusters_leave_broken_vectors_out(spark):
    rows = [(0, [0.0, 0.0]), (1, [0.1, 0.0]), (2, [9.0, 9.0]), (3, [9.1, 9.0]), (4, None), (5, [None, 1.0]), (6, [1.0]), (7, [])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    for init in ([[0.0, 0.0], [9.0, 9.0]], None):
        got = {r["id"]: r["cluster"] for r in vc.cluster(df, "vector", 2, init=init).collect()}
        assert len(got) == 8 and got[0] == got[1] != got[2] == got[3]
        assert {got[i] for i in (0, 2)} == {0, 1} and {got[i] for i in (4, 5, 6, 7)} == {None}
    assert {r["cluster"] for r in vc.cluster(df.filter("id IN (0, 4)"), "vector", 3).collect()} == {0, None}
    assert vc.cluster(df.limit(0), "vector").count() == 0


def test_pages_without_document_or_number(spark):
    rows = [(None, i) for i in range(40)] + [("d", None), ("d", 7), ("d", 3)]
    got = ag.sample_pages(spark.createDataFrame(rows, "document_id string, page_no long")).collect()
    assert sorted(r["page_no"] for r in got if r["document_id"] is None) == list(range(0, 30, 2))
    assert {(r["page_no"], r["total_pages"]) for r in got if r["document_id"] == "d"} == {(None, 3), (3, 3), (7, 3)}


def test_embedding_holds_parts_of_long_texts(spark):
    """Every text's vector is the size of the part it was embedded with."""
    texts = spark.range(0, 3000, numPartitions=1).select("id", F.repeat(F.lit("ab c "), 1000).alias("text"))
    texts = texts.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.repeat(F.lit("x"), 3_000_000).alias("text")))
    sizes = lambda part: np.full((len(part), 1), float(sum(map(len, part))))
    found = {r["id"]: r["v"][0] for r in texts.select("id", embed(F.col("text"), sizes).alias("v")).collect()}
    assert len(found) == 3001 and found.pop(-1) == 3_000_000 and max(found.values()) <= PART_BYTES


def test_copies_at_the_cut_make_no_more_hits_than_k():
    rows = pd.DataFrame({"id": np.arange(40_000)[::-1], "vector": [np.ones(4)] * 40_000})
    asked = pd.DataFrame({"query_id": np.arange(100), "vector": [np.ones(4)] * 100})
    tracemalloc.start()
    found = vc._best(rows, asked, None, 2, 0.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    best = found.sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id").head(2)
    assert best["id"].tolist() == [0, 1] * 100 and set(best["score"]) == {1.0}
    assert peak < 100e6


def test_a_text_is_graded_without_a_second_look_at_its_ascii(spark):
    """each candidate was trimmed twice, and every character of it went through the class of valid ones."""
    texts = ["", None, " \t plain\n", "é\u0001\u0002b\u0003", "�" * 5 + "abc" + "�", "× 日本 \U0001f600 x\r\n\u007f", "a\u0000b　"]
    rows = [(i, "DIGITAL_BOOK", t, 1, 0, "DIGITAL_BOOK") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "document_id int, profile string, text string, pages int, file_size int, start_profile string")
    got = quality.quality(df).orderBy("document_id").collect()
    for r in got:
        clean = (r["text"] or "").strip()
        bad = sum(not re.fullmatch(r"[^\W_]|[!-~]|\s|[À-ỹ‐-…]", c) for c in clean)
        assert r["total_chars"] == len(clean) and round(r["valid_char_ratio"], 9) == round((len(clean) - bad) / len(clean) if clean else 0, 9)
        assert round(r["replacement_ratio"], 9) == round(clean.count("�") / max(1, len(clean)), 9)
    plan = quality.choose_extraction(df)._jdf.queryExecution().optimizedPlan().toString()
    assert quality.PLAIN in plan or "[ -~" in plan
    assert plan.count("trim(") == 1
