"""Passages of held-out items in documents, whole or altered.

Both sides are cut into windows of ``WINDOW`` words, the least stretch that counts.
A window is embedded by a random walk: at each step the word under the pointer is
put out and a random bit, drawn from the word, the step and the round, says
whether the pointer moves on.  Windows at a small edit distance then agree in most
steps, so words sampled at a few steps are a bucket key of a locality-sensitive
hash.  ``ROUNDS`` independent rounds bring the recall of windows with two edits
near 1.  Every bucket hit is verified by an exact alignment.

A window can only match if nearly all its words occur in the items at all; the
others are not walked.  Items are small: their buckets are sent to the tasks in
blocks of ``BLOCK`` items, one pass over the documents each.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.spread import spread

WINDOW, EDIT_SHARE = 15, 8
ROUNDS, SAMPLED, STEPS = 24, 4, 24
#: Items, and characters of them, that are sent to the tasks at once.
BLOCK, BLOCK_CHARS = 2_000, 8_000_000
#: Words of a window that do not occur in any item: three edits, and one more for the ragged end.
STRANGE = 4
#: Edits of a window that rounds are made to bridge; a hit is dropped with one more word gone than these.
DRIFT = 2

_TAG = re.compile(r"</?[a-z][^<>]{0,200}>|<!--.*?-->", re.S)
_LEAD = re.compile(r"^[ \t]*(?:>[ \t]*)*(?:\[\d{1,2}:\d{2}(?::\d{2})?\]|\|[ \t]*\d+[ \t]*(?=\|)|(?:[-*+•]|\d{1,3}[.)])(?=[ \t]))?", re.M)
_WORD = re.compile(r"\w+")
_DROP = re.compile("[­​-‍﻿\\\\]")


def words(text: str | None) -> list[str]:
    """Words without regard to case, punctuation, markup, quotation marks, line breaks and spacing."""
    if not text:
        return []
    t = text.lower()
    if "&" in t:
        t = html.unescape(t)
    if "<" in t:
        t = _TAG.sub(" ", t)
    t = _DROP.sub("", _LEAD.sub(" ", t))
    return [w for x in _WORD.findall(t) if (w := x.strip("_"))]


def _hash(w: str) -> int:
    return xxhash.xxh3_64_intdigest(w)


def _spread(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))


def walk_keys(stream: np.ndarray, starts: np.ndarray, vocabulary: np.ndarray, round_: int, window: int = WINDOW, sampled: int = SAMPLED, steps: int = STEPS) -> np.ndarray:
    """The bucket key of each window in one round.

    ``stream`` holds word numbers with at least ``window`` zeros (padding) at its end,
    ``vocabulary`` the 64-bit hash of each word.
    """
    rng = np.random.default_rng(1_000 + round_)
    take = np.sort(rng.choice(steps, sampled, replace=False))
    bits = _spread(vocabulary, round_ + 1)
    at = np.zeros(len(starts), np.int64)
    key = np.full(len(starts), round_ + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(int(take[-1]) + 1):
            word = np.where(at < window, stream[starts + np.minimum(at, window - 1)], 0)
            if j in take:
                key = (key ^ vocabulary[word]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(32)
            at += ((bits[word] >> np.uint64(j)) & np.uint64(1)).astype(np.int64)
    return key


def aligned(items: list[np.ndarray], docs: list[np.ndarray], shifts: np.ndarray, least: int = WINDOW, share: int = EDIT_SHARE, slack: int = 6) -> np.ndarray:
    """Whether each item and document have a stretch of at least ``least`` item words with at most one edit in ``share`` words.

    ``shifts`` are document minus item positions, good to within ``slack``.  An exact
    alignment of the whole item over all numbers of edits, for many pairs at once.
    """
    n, longest = len(items), max(len(x) for x in items)
    edits = longest // share
    half = edits + slack
    band = 2 * half + 1
    item = np.full((n, longest), -1, np.int32)
    doc = np.full((n, longest + band), -2, np.int32)
    for k, (x, d, s) in enumerate(zip(items, docs, shifts.tolist(), strict=True)):
        item[k, : len(x)] = x
        low = s - half
        a, b = max(low, 0), min(low + longest + band, len(d))
        if b > a:
            doc[k, a - low : b - low] = d[a:b]
    # at least seven of eight words of a stretch are kept, so some window of it has so many words of the document near the diagonal
    near = np.zeros((n, longest), bool)
    for b in range(band):
        near |= doc[:, b : b + longest] == item
    run = np.cumsum(np.pad(near, ((0, 0), (1, 0))), axis=1, dtype=np.int32)
    kept = least - -(-least // share)
    likely = np.flatnonzero((run[:, least:] - run[:, :-least] >= kept).any(axis=1)) if longest >= least else np.zeros(0, np.int64)
    out = np.zeros(n, bool)
    item, doc = item[likely], doc[likely]
    n = len(likely)
    if not n:
        return out
    ok = np.zeros(n, bool)
    low_bar = [max(least, share * e) for e in range(edits + 1)]
    before = [np.zeros((n, band), np.int16) for _ in range(edits + 1)]
    for i in range(longest):
        here = item[:, i : i + 1]
        same = (doc[:, i : i + band] == here) & (here >= 0)
        now: list[np.ndarray] = []
        for e in range(edits + 1):
            f = np.where(same, before[e] + 1, 0).astype(np.int16)
            if e:
                lower = before[e - 1]
                f = np.maximum(f, np.where(here >= 0, lower + 1, 0))
                f[:, :-1] = np.maximum(f[:, :-1], np.where(here >= 0, lower[:, 1:] + 1, 0))
                f[:, 1:] = np.maximum(f[:, 1:], now[e - 1][:, :-1])
                f = np.maximum(f, now[e - 1])
            now.append(f)
            ok |= (f >= low_bar[e]).any(axis=1)
        before = now
        if ok.all():
            break
    out[likely] = ok
    return out


class Items:
    """Buckets of a block of items."""

    def __init__(self, rows: list[tuple[int, str]], rounds: int = ROUNDS) -> None:
        self.ids, self.words, self.number = [], [], {}
        for id_, text in rows:
            w = words(text)
            if id_ is not None and len(w) >= WINDOW:
                self.ids.append(id_)
                self.words.append(np.array([self.number.setdefault(x, len(self.number) + 1) for x in w], np.int64))
        self.rounds = rounds
        self.vocabulary = np.array([0, *(_hash(w) for w in self.number)], np.uint64)
        parts, owner, place, begin = [], [], [], []
        size = 0
        for k, w in enumerate(self.words):
            parts += [w, np.zeros(WINDOW, np.int64)]
            count = len(w) - WINDOW + 1
            begin.append(size + np.arange(count))
            owner.append(np.full(count, k))
            place.append(np.arange(count))
            size += len(w) + WINDOW
        self.tables = []
        if not self.ids:
            return
        stream, starts = np.concatenate(parts), np.concatenate(begin)
        self.owner, self.place = np.concatenate(owner), np.concatenate(place)
        self.windows = stream[starts[:, None] + np.arange(WINDOW)].astype(np.int32)
        for r in range(rounds):
            keys = walk_keys(stream, starts, self.vocabulary, r)
            order = np.argsort(keys, kind="stable")
            bits = np.zeros(1 << 18, bool)
            bits[keys & np.uint64((1 << 18) - 1)] = True
            self.tables.append((keys[order], order, bits))

    def _alike(self, stream: np.ndarray, starts: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Which bucket hits are no chance: two windows at two edits share 13 words in place to within two."""
        out = np.zeros(len(w), bool)
        for a in range(0, len(w), 200_000):
            at = starts[a : a + 200_000, None] + np.arange(-DRIFT, WINDOW + DRIFT)
            doc, item = stream[np.maximum(at, 0)].astype(np.int32), self.windows[w[a : a + 200_000]]
            kept = np.zeros(item.shape, bool)
            for b in range(2 * DRIFT + 1):
                kept |= doc[:, b : b + WINDOW] == item
            out[a : a + 200_000] = kept.sum(axis=1) >= WINDOW - DRIFT - 1
        return out

    def search(self, texts: list[tuple[int, str]]) -> list[tuple[int, int]]:
        """(document, item) pairs of some documents."""
        if not self.ids:
            return []
        known = dict(self.number)
        n_items, docs, stream_parts, doc_of, start_of, base = len(known), [], [], [], [], 0
        strange_of: list[np.ndarray] = []
        for id_, text in texts:
            w = words(text)
            # words of no item are numbered too, as they take part in the walk
            num = np.array([known.setdefault(x, len(known) + 1) for x in w], np.int64)
            docs.append((id_, num))
            if len(num) < WINDOW - WINDOW // EDIT_SHARE:
                continue
            stream_parts += [num, np.zeros(WINDOW, np.int64)]
            total = np.concatenate(([0], np.cumsum(np.concatenate((num > n_items, np.zeros(WINDOW, bool))))))
            count = len(num) - (WINDOW - WINDOW // EDIT_SHARE) + 1
            ok = total[WINDOW : WINDOW + count] - total[:count] <= STRANGE
            at = np.flatnonzero(ok)
            start_of.append(base + at)
            doc_of.append(np.full(len(at), len(docs) - 1))
            strange_of.append(at)
            base += len(num) + WINDOW
        if not stream_parts:
            return []
        stream, starts, owner = np.concatenate([*stream_parts, np.zeros(WINDOW, np.int64)]), np.concatenate(start_of), np.concatenate(doc_of)
        places = np.concatenate(strange_of)
        if not len(starts):
            return []
        vocabulary = np.concatenate((self.vocabulary, np.array([_hash(w) for w in list(known)[n_items:]], np.uint64)))
        hits: list[np.ndarray] = []
        for r, (keys, order, bits) in enumerate(self.tables):
            got = walk_keys(stream, starts, vocabulary, r)
            some = np.flatnonzero(bits[got & np.uint64((1 << 18) - 1)])
            low, high = np.searchsorted(keys, got[some], "left"), np.searchsorted(keys, got[some], "right")
            many = high - low
            if not many.any():
                continue
            which = np.repeat(some, many)
            within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            w = order[np.repeat(low, many) + within]
            alike = self._alike(stream, starts[which], w)
            which, w = which[alike], w[alike]
            shift = places[which] - self.place[w]
            hits.append(np.unique(np.stack((owner[which], self.owner[w], shift // 6), axis=1), axis=0))
        if not hits:
            return []
        found = np.unique(np.concatenate(hits), axis=0)
        out: list[tuple[int, int]] = []
        for a in range(0, len(found), 1_000):
            part = found[a : a + 1_000]
            ok = aligned([self.words[k] for k in part[:, 1]], [docs[d][1] for d in part[:, 0]], part[:, 2] * 6 + 3)
            out += {(docs[d][0], self.ids[k]) for d, k in part[ok][:, :2].tolist()}
        return sorted(set(out))


def leaked(documents: DataFrame, items: DataFrame, doc: str = "doc_id", doc_text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id) of documents that hold a stretch of an item.

    Whole texts; null and short texts hold nothing, and an item of fewer than 15 words
    is never found.  Items are taken in blocks of bounded size, each against all
    documents.
    """
    sized = items.select(F.col(item).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).filter("item_id is not null and text is not null").distinct()
    n, chars = sized.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK), -(-chars // BLOCK_CHARS))
    out = None
    for b in range(blocks):
        rows = [(r["item_id"], r["text"]) for r in (sized.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else sized).collect()]
        part = _against(documents.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(doc_text).alias("text")), rows)
        out = part if out is None else out.unionByName(part)
    return out.distinct() if blocks > 1 else out


def _against(documents: DataFrame, rows: list[tuple[int, str]]) -> DataFrame:
    held = documents.sparkSession.sparkContext.broadcast(rows)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(held.value)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            pairs: list[tuple[int, int]] = []
            for a in range(0, len(ids), 2_000):
                pairs += items.search([(i, t) for i, t in zip(ids[a : a + 2_000], texts[a : a + 2_000], strict=True) if i is not None and t])
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["doc_id", "item_id"])

    return spread(documents, "doc_id").mapInArrow(find, "doc_id bigint, item_id bigint").distinct()
