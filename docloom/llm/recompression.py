"""Substring dedup by recompression: names of word pairs reveal long repeats, windows verify them.

A round of recompression splits all symbols into left and right ones by a hash and names every
(left, right) neighbourhood as one new symbol. Names are fingerprints of content, so one round
names pairs alike in the whole corpus, and equal substrings get equal symbols but for at most one
symbol at either edge. A run of one symbol never pairs (it has one side), and its equal symbols
give one anchor, so runs need no names of their own.

Of the symbols, runs of at least TUPLE_WORDS words are taken; of each PICK neighbouring ones the
least by hash is an anchor. For windows of 13 words one round leaves 11 words alike, which hold
PICK such runs, so two equal windows always share an anchor. Anchors that several documents have
reveal where windows may repeat; those windows alone are then compared, whole, by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, map_texts, mix, powers, release, runs, split_by_sieve, word_hashes

WINDOW = 13
ROUNDS = 1
TUPLE_WORDS, PICK = 6, 3
#: Entries that a task sorts and combines before it hands them on; entries of one bucket of the corpus.
FLUSH, BUCKET = 1 << 20, 1 << 18
_BASE = 0xD1342543DE82EF95
_UNBASE = pow(_BASE, -1, 1 << 64)
_LAST = (1 << 63) - 1


def guaranteed(window: int, rounds: int, words: int, pick: int) -> bool:
    """Whether each window surely holds ``pick`` neighbouring symbol runs of ``words`` words or more.

    A round leaves out one symbol at either edge, which is up to twice as wide as in the round before.
    """
    width = 1 << rounds
    inside = window - 2 * (width - 1)
    return (pick - 1) * width + words + width - 1 <= inside


def parse(words: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Word numbers where the symbols of the last round start, over all texts; a sorted array."""
    starts, names = np.arange(len(words)), words
    breaks = np.zeros(len(words) + 1, bool)
    breaks[first] = True  # no pair reaches over a text's end
    for r in range(rounds):
        left = (mix(names + np.uint64(r + 1)) & np.uint64(1)).astype(bool)
        pair = left[:-1] & ~left[1:] & ~breaks[starts[1:]]
        named = names.copy()
        named[:-1][pair] = mix(mix(names[:-1][pair]) + names[1:][pair])
        stays = np.concatenate(([True], ~pair)) if len(names) else np.zeros(0, bool)
        starts, names = starts[stays], named[stays]
    return starts


def spans_hash(words: np.ndarray, begin: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of word spans, alike wherever they stand."""
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words + np.uint64(salt)) * powers(_BASE, len(words)), out=total[1:])
    return mix((total[end] - total[begin]) * powers(_UNBASE, len(words) + 1)[begin] + (end - begin).astype(np.uint64))


def anchors(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first word, end word and key of every anchor."""
    starts = parse(words, first)
    bounds = np.union1d(starts, first)
    text = np.searchsorted(first, starts, "right") - 1
    at = np.searchsorted(bounds, starts + TUPLE_WORDS)
    fits = at < len(bounds)
    fits[fits] = bounds[at[fits]] <= first[text[fits] + 1]
    begin, text = starts[fits], text[fits]
    end = bounds[at[fits]]
    key = spans_hash(words, begin, end)
    n = len(key)
    chosen = np.zeros(n, bool)
    if n:
        # windows of PICK runs of one text; a text with fewer has no window of words either
        best = np.arange(n)
        for i in range(1, PICK):
            other = np.minimum(np.arange(n) + i, n - 1)
            better = (text[other] == text) & (key[other] < key[best])
            best = np.where(better, other, best)
        chosen[best] = True
    return text[chosen], begin[chosen], end[chosen], key[chosen]


def _distinct(owners: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((*keys.T, owners))
    owners, keys = owners[order], keys[order]
    new = np.ones(len(owners), bool)
    new[1:] = (owners[1:] != owners[:-1]) | (keys[1:] != keys[:-1]).any(axis=1)
    return owners[new], keys[new]


def _by_key(owners: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries by key and owner, the number of each one's key, and the index of each key's first entry."""
    order = np.lexsort((owners, *keys.T[::-1]))
    owners, keys = owners[order], keys[order]
    new = np.ones(len(owners), bool)
    new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    return owners, keys, np.cumsum(new) - 1, np.flatnonzero(new)


_PACK = "bucket long, owners binary, keys binary, known binary"
_NAMES = ["bucket", "owners", "keys", "known"]


def _repeats(
    rows: DataFrame, columns: list[str], entries: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]],
    width: int, n_buckets: int, others_only: bool,
) -> DataFrame:
    """(owner, keys): which of each owner's keys another owner has too; keys packed, a row for each owner.

    With ``others_only`` the least owner of a key is left out. Each task first combines its own
    entries: of a key it passes on one, its least owner's, and reports the rest at once. So a key
    that stands everywhere reaches its bucket once a task, and no bucket grows with a hot key.
    """

    def shared(owners, number, heads):
        if others_only:
            return owners > owners[heads][number]
        several = np.maximum.reduceat(owners, heads) > owners[heads] if len(heads) else np.zeros(0, bool)
        return several[number]

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        turn = 0

        def flush():
            nonlocal turn
            owners, keys, number, heads = _by_key(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            held.clear()
            hit = shared(owners, number, heads)
            out = []
            if hit.any():  # settled here; spread over buckets of their own
                turn += 1
                spot = n_buckets + int(mix(np.uint64([turn + int(owners[0]) * 1_000_003 % (1 << 40)]))[0] % np.uint64(n_buckets))
                out.append((spot, owners[hit].tobytes(), keys[hit].tobytes(), b""))
            owners, keys, known = owners[heads], keys[heads], hit[heads] if not others_only else np.zeros(len(heads), bool)
            edges = (np.arange(1, n_buckets, dtype=object) * (1 << 64) // n_buckets).astype(np.uint64)
            cuts = [0, *np.searchsorted(keys[:, 0], edges).tolist(), len(keys)]
            for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if j > i:
                    out.append((b, owners[i:j].tobytes(), keys[i:j].tobytes(), known[i:j].tobytes()))
            for row in out:
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[1:])], names=_NAMES)

        count = 0
        for batch in batches:
            for part in runs(batch):
                owners, keys = _distinct(*entries(part))
                held.append((owners, keys))
                count += len(owners)
                if count >= FLUSH:
                    yield from flush()
                    count = 0
        if count:
            yield from flush()

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        owners = np.frombuffer(b"".join(table.column("owners").to_pylist()), np.int64)
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint64).reshape(-1, width)
        if key[0].as_py() < n_buckets:
            known = np.frombuffer(b"".join(table.column("known").to_pylist()), bool)
            known = known[np.lexsort((owners, *keys.T[::-1]))]
            owners, keys, number, heads = _by_key(owners, keys)
            hit = shared(owners, number, heads) & ~known  # known ones were reported before
            owners, keys = owners[hit], keys[hit]
        # packed for the owners' buckets: never more rows than entries
        spot = (mix(owners.astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
        order = np.lexsort((owners, spot))
        spot, owners, keys = spot[order], owners[order], keys[order]
        found, cut = np.unique(spot, return_index=True)
        cuts = [*cut.tolist(), len(spot)]
        parts = list(zip(cuts, cuts[1:], strict=False))
        return pa.table({
            "spot": pa.array(found, pa.int64()),
            "owners": pa.array([owners[i:j].tobytes() for i, j in parts], pa.binary()),
            "keys": pa.array([keys[i:j].tobytes() for i, j in parts], pa.binary()),
        })

    def gather(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        owners = np.frombuffer(b"".join(table.column("owners").to_pylist()), np.int64)
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint64).reshape(-1, width)
        owners, keys = _distinct(owners, keys)
        found, cut = np.unique(owners, return_index=True)
        cuts = [*cut.tolist(), len(owners)]
        packed = [keys[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)]
        return pa.table({"owner": pa.array(found, pa.int64()), "keys": pa.array(packed, pa.binary())})

    packs = rows.select(*columns).mapInArrow(combine, _PACK)
    met = packs.groupBy("bucket").applyInArrow(meet, "spot long, owners binary, keys binary")
    return met.groupBy("spot").applyInArrow(gather, "owner long, keys binary")


def _set(pack: bytes, width: int) -> np.ndarray:
    return np.frombuffer(pack, np.uint64).reshape(-1, width)


def _anchor_entries(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    words, first = word_hashes(part.column("text"))
    text, _, _, key = anchors(words, first)
    return part.column("class").to_numpy()[text], key[:, None]


def _window_keys(words: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.stack([spans_hash(words, begin, begin + WINDOW), spans_hash(words, begin, begin + WINDOW, salt=17)], axis=1)


def _window_entries(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Windows around the anchors that other documents share."""
    words, first = word_hashes(part.column("text"))
    text, begin, end, key = anchors(words, first)
    open_ = np.zeros(len(words) + 1, np.int64)
    for t, packs in enumerate(part.column("shared").to_pylist()):
        i, j = np.searchsorted(text, [t, t + 1])
        hit = i + np.flatnonzero(np.isin(key[i:j], _set(packs, 1)[:, 0]))
        low = np.maximum(end[hit] - WINDOW, first[t])
        high = np.minimum(begin[hit], first[t + 1] - WINDOW)
        fine = low <= high
        np.add.at(open_, low[fine], 1)
        np.add.at(open_, high[fine] + 1, -1)
    begin = np.flatnonzero(np.cumsum(open_)[:-1] > 0)
    owners = part.column("owner").to_numpy()[np.searchsorted(first, begin, "right") - 1]
    return owners, _window_keys(words, begin)


def _kept_words(text: str | None, covered: np.ndarray | None) -> tuple[int, int, str]:
    words = (text or "").encode().split()
    left = words if covered is None else [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
    return len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()


def _first_look(part: pa.RecordBatch) -> dict:
    """Results of later copies of a text and of documents without a shared anchor; the others keep their text."""
    out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "text": []}
    rows = zip(*(part.column(c).to_pylist() for c in ("text", "shared", "copy")), strict=True)
    for text, pack, copy in rows:
        later = pack is not None and not copy
        n, gone, sha = (None, None, None) if later else _kept_words(text, None)
        if copy and n >= WINDOW:  # each of its windows starts in the first document with this text
            gone, sha = n, hashlib.sha256(b"").hexdigest()
        for name, value in (("n_words", n), ("n_removed", gone), ("kept_sha256", sha), ("text", text if later else None)):
            out[name].append(value)
    shared = pa.array([p if t is not None else None for p, t in zip(part.column("shared").to_pylist(), out["text"], strict=True)], pa.binary())
    return out | {"doc_id": part.column("doc_id"), "owner": part.column("owner"), "shared": shared}


def _remove(part: pa.RecordBatch) -> dict:
    words, first = word_hashes(part.column("text"))
    out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": []}
    for t, (text, packs) in enumerate(zip(part.column("text").to_pylist(), part.column("gone").to_pylist(), strict=True)):
        own = words[first[t] : first[t + 1]]
        covered = np.zeros(len(own) + 1, np.int64)
        if packs and len(own) >= WINDOW:
            begin = np.arange(len(own) - WINDOW + 1)
            keys, gone = _window_keys(own, begin), _set(packs, 2)
            pair = np.dtype([("a", np.uint64), ("b", np.uint64)])
            hit = np.isin(np.ascontiguousarray(keys).view(pair)[:, 0], np.ascontiguousarray(gone).view(pair)[:, 0])
            np.add.at(covered, begin[hit], 1)
            np.add.at(covered, begin[hit] + WINDOW, -1)
        n, removed, sha = _kept_words(text, np.cumsum(covered)[:-1] > 0)
        for name, value in (("n_words", n), ("n_removed", removed), ("kept_sha256", sha)):
            out[name].append(value)
    return out | {"doc_id": part.column("doc_id")}


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; one row per row of ``docs`` (doc_id, text).

    A word goes if a window of 13 words that covers it also starts in a document with a smaller
    doc_id; all windows are those of the input. Words are compared as they are. A null or empty
    text has no words, a text of fewer than 13 words loses none. Rows of one doc_id never remove
    one another's words; a null doc_id counts as the largest of all. An empty table gives no rows.
    """
    if not guaranteed(WINDOW, ROUNDS, TUPLE_WORDS, PICK):
        raise ValueError("equal windows might share no anchor")
    kept = Kept(docs.sparkSession, "recompression")
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).cast("long").alias("owner"), "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n_buckets = 1 + size // 12 // BUCKET  # more buckets than anchors fill, at about six bytes a word
    # equal texts are one class: its copies have no anchors of their own to compare
    rows = rows.withColumn("class", F.xxhash64("text")).withColumn("digest", F.md5("text"))
    found = _repeats(rows, ["class", "text"], _anchor_entries, 1, n_buckets, others_only=False)
    classes = rows.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.min("owner").alias("least"), F.max("owner").alias("most"), F.min("class").alias("class")
    )
    classes = classes.join(found.withColumnsRenamed({"owner": "class", "keys": "shared"}), "class", "left")
    # only texts with a shared anchor or a copy have anything to learn; the others never leave their task
    classes = kept(classes.filter("shared IS NOT NULL OR least <> most").select("digest", "least", "shared"))
    release(docs.sparkSession)
    open_, shut = split_by_sieve(rows.drop("class"), "digest", classes.select("digest"))
    facts = open_.join(classes, "digest", "left").withColumn("copy", F.coalesce(F.col("owner") > F.col("least"), F.lit(False)))
    facts = facts.select("doc_id", "owner", "text", "shared", "copy").unionByName(
        shut.select("doc_id", "owner", "text", F.lit(None).cast("binary").alias("shared"), F.lit(False).alias("copy"))
    )
    looked = kept(map_texts(
        facts, ["doc_id", "owner", "text", "shared", "copy"],
        "doc_id long, owner long, n_words long, n_removed long, kept_sha256 string, text string, shared binary", _first_look,
    ))
    release(docs.sparkSession)
    maybe = looked.filter("shared IS NOT NULL")
    gone = _repeats(maybe, ["owner", "text", "shared"], _window_entries, 2, n_buckets, others_only=True)
    cut = map_texts(
        maybe.join(gone.withColumnRenamed("keys", "gone"), "owner", "left"), ["doc_id", "text", "gone"],
        "doc_id long, n_words long, n_removed long, kept_sha256 string", _remove,
    )
    return looked.filter("shared IS NULL").select("doc_id", "n_words", "n_removed", "kept_sha256").unionByName(cut)
