"""Byte-pair encoding and decoding over a minimal acyclic transducer.

The most frequent words of the corpus are compiled into an automaton whose equal suffixes are
shared. Each arc carries how many words precede it, so the sum along a path is a word's number,
which points at its ids. The automaton is a flat file of integers that every Python worker
memory-maps; the words of a batch walk it together, one byte at a time. Words it does not hold
are merged exactly by the ranks of the tokenizer file.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import list_array, materialize, scratch_path, small_batches, span_index, text_slices

#: Fixed values of the byte-level vocabulary: its splitting pattern and its end token.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = "<|endoftext|>"

_CACHE = 400_000
#: Bytes of words, units and ids that one encoder keeps (by estimate: text, two objects and a table entry a word).
_CACHE_BYTES, _ENTRY_BYTES = 48 << 20, 176
#: Words of more bytes are merged by a heap; the rank of no pair.
_LONG, _NEVER = 48, 1 << 40


_MASK = (1 << 20) - 1


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64) & _MASK


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Vocabulary and merge ranks of a tokenizer file; exact merging of one word."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab = model["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"] if t["special"]}
        letters = _byte_letters()
        self.byte = [0] * 256
        self.tokens: dict[int, bytes] = {i: t.encode() for t, i in self.special.items()}
        for token, i in vocab.items():
            if i not in self.tokens:
                self.tokens[i] = bytes(letters[c] for c in token)
            if len(token) == 1:
                self.byte[letters[token]] = i
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])
        # Pairs in an open-addressed table that is mostly empty: one or two reads find a pair or its absence.
        pairs = np.array([((a << 17) | b, rank, new) for (a, b), (rank, new) in self.ranks.items()], np.int64)
        self.slots = np.full(1 << 20, -1, np.int32)
        self.pair_keys, self.pair_ranks, self.pair_new = (np.append(c, x) for c, x in zip(pairs.T, (-1, _NEVER, 0), strict=True))
        left = np.arange(len(pairs))
        slot = _slot(self.pair_keys[:-1])
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            left, slot = (x[self.slots[slot] != left] for x in (left, slot))
            slot = (slot + 1) & _MASK
        self.byte_ids = np.array(self.byte, np.int64)
        size = max(self.tokens) + 1
        lengths = np.array([len(self.tokens.get(i, b"")) for i in range(size)], np.int64)
        self.lengths, self.begins = lengths, np.cumsum(lengths) - lengths
        self.bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8)

    def word(self, word: bytes) -> list[int]:
        """Ids of a word: always the pair of least rank, the leftmost first. A heap keeps long words near linear."""
        ids = [self.byte[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        ranks, after, before = self.ranks, [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if r := ranks.get((new, ids[after[j]])):
                    heapq.heappush(heap, (r[0], i, new, ids[after[j]], r[1]))
            if before[i] >= 0 and (r := ranks.get((ids[before[i]], new))):
                heapq.heappush(heap, (r[0], before[i], ids[before[i]], new, r[1]))
        return [x for x in ids if x >= 0]

    def _find(self, key: np.ndarray) -> np.ndarray:
        """The row of each pair, the last one for pairs that never merge."""
        slot = _slot(key)
        at = self.slots[slot]
        open_ = np.flatnonzero((at >= 0) & (self.pair_keys[at] != key))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & _MASK
            at[open_] = self.slots[slot[open_]]
            open_ = open_[(at[open_] >= 0) & (self.pair_keys[at[open_]] != key[open_])]
        return at

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words in a row, and how many each has: in each round every word merges its pair of least rank.

        A token made by a merge only enters pairs of a higher rank, so all places of a pair merge in
        one round, overlapping ones from the left. Long words take the heap.
        """
        sizes = np.array([len(w) for w in words], np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for i in np.flatnonzero(sizes > _LONG).tolist():
            ids = self.word(words[i])
            done.append((np.full(len(ids), i), np.array(ids, np.int64)))
        short = np.flatnonzero(sizes <= _LONG)
        ids = self.byte_ids[np.frombuffer(b"".join(words[i] for i in short.tolist()), np.uint8)]
        owner = np.repeat(short, sizes[short])
        while len(ids):
            key = (ids[:-1] << np.int64(17)) | ids[1:]
            at = self._find(key)
            rank = np.append(np.where(owner[1:] == owner[:-1], self.pair_ranks[at], _NEVER), _NEVER)
            lead = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank, lead)
            least = np.repeat(least, np.diff(np.append(lead, len(ids))))
            ended = least == _NEVER
            if ended.any():
                done.append((owner[ended], ids[ended]))
            hit = np.flatnonzero((rank == least) & ~ended)
            if len(hit):
                # Of places that overlap, every second one of the row, from its first.
                begin = np.append(True, np.diff(hit) > 1)
                row = hit[np.maximum.accumulate(np.where(begin, np.arange(len(hit)), 0))]
                hit = hit[(hit - row) % 2 == 0]
            keep = ~ended
            ids = ids.copy()
            ids[hit] = self.pair_new[at[hit]]
            keep[hit + 1] = False
            ids, owner = ids[keep], owner[keep]
        if not done:
            return np.zeros(0, np.int32), sizes
        owner, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        return ids[order].astype(np.int32), np.bincount(owner, minlength=len(words))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids; an id outside the vocabulary has none."""
        ids = ids[(ids >= 0) & (ids < len(self.lengths))]
        return self.bytes[span_index(self.begins[ids], self.lengths[ids])].tobytes()


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


# ---- the transducer --------------------------------------------------------


def compile_words(words: Iterable[bytes], ids_of) -> bytes:
    """The automaton of sorted distinct words, with their ids, as int32 numbers.

    States are made from the ends of words on: a state with the same arcs and finality as an
    earlier one is that one. Layout: five lengths, then keys (state * 256 + byte, sorted),
    targets, words before each arc, finality of states, id offsets, ids.
    """
    words = sorted(set(words))
    register: dict[tuple, int] = {}
    arcs: list[tuple] = []
    finals: list[int] = []
    counts: list[int] = []

    def close(node: list) -> int:
        signature = (node[0], tuple(node[1]))
        state = register.get(signature)
        if state is None:
            state = register[signature] = len(arcs)
            arcs.append(signature[1])
            finals.append(node[0])
            counts.append(node[0] + sum(counts[t] for _, t in node[1]))
        return state

    path: list[list] = [[0, []]]
    last = b""
    for word in words:
        common = 0
        while common < min(len(last), len(word)) and last[common] == word[common]:
            common += 1
        for i in range(len(last), common, -1):
            path[i - 1][1].append((last[i - 1], close(path.pop())))
        path += [[0, []] for _ in word[common:]]
        path[-1][0] = 1
        last = word
    for i in range(len(last), 0, -1):
        path[i - 1][1].append((last[i - 1], close(path.pop())))
    root = close(path[0])
    keys, targets, skips = [], [], []
    for state, out in enumerate(arcs):
        seen = finals[state]
        for byte, target in out:
            keys.append(state * 256 + byte)
            targets.append(target)
            skips.append(seen)
            seen += counts[target]
    encoded = [ids_of(w) for w in words]
    offsets = np.cumsum([0, *map(len, encoded)])
    parts = [keys, targets, skips, finals, offsets, list(chain.from_iterable(encoded))]
    return np.concatenate([np.asarray(x, np.int64) for x in ([root, len(keys), len(finals), len(offsets), int(offsets[-1])], *parts)]).astype(np.int32).tobytes()


class Lexicon:
    """A compiled file, memory-mapped."""

    def __init__(self, path: str) -> None:
        flat = np.memmap(path, np.int32, "r")
        self.root, n_arcs, n_states, n_offsets, n_ids = (int(x) for x in flat[:5])
        cuts = np.cumsum([5, n_arcs, n_arcs, n_arcs, n_states, n_offsets, n_ids])
        self.keys, self.targets, self.skips, self.final, self.offsets, self.ids = (flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False))

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, or -1; all words take one arc at a time."""
        sizes = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        begins = np.cumsum(sizes) - sizes
        state, number = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        live = np.flatnonzero(sizes > 0) if len(self.keys) else np.zeros(0, np.int64)
        number[sizes == 0] = -1
        if not len(self.keys):
            return np.full(len(words), -1)
        step = 0
        while len(live):
            key = state[live] * 256 + data[begins[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            number[live[~known]] = -1
            live, at = live[known], at[known]
            number[live] += self.skips[at]
            state[live] = self.targets[at]
            step += 1
            ended = sizes[live] == step
            done = live[ended]
            number[done[self.final[state[done]] == 0]] = -1
            live = live[~ended]
        return number


class Encoder:
    """Encodes texts; keeps the ids of the words it has met, within ``_CACHE_BYTES``: when they are full, those met often stay."""

    def __init__(self, path: str, lexicon: Lexicon | None) -> None:
        self.merges, self.lexicon = merges(path), lexicon
        self.split = regex.compile(PATTERN).findall
        self.specials = regex.compile("(" + "|".join(regex.escape(t) for t in self.merges.special) + ")") if self.merges.special else None
        self.touching = re.compile(r"\s\s").search
        self._reset()

    def _reset(self) -> None:
        # Numbers of pieces, and of units (a piece of text between spaces, with the space before it); both point into one table of ids.
        self.pieces: dict[str, int] = {}
        self.units: dict[str, int] = {}
        self.flat, self.offsets, self.uses = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.rows, self.held = 0, 0
        for special, i in self.merges.special.items():
            self.pieces["\0" + special] = self._add(np.array([i], np.int32), np.ones(1, np.int64))

    def _shrink(self) -> None:
        """Start afresh with the words met most often since the last time, in half of the room at most."""
        old, flat, offsets, uses = (self.pieces, self.units), self.flat, self.offsets, self.uses[: self.rows]
        names = [list(table) for table in old]
        rows = [np.fromiter(table.values(), np.int64, len(table)) for table in old]
        every = np.concatenate(rows)
        cost = 4 * (offsets[every + 1] - offsets[every]) + _ENTRY_BYTES + np.array([len(w) for w in chain(*names)])
        often = np.argsort(-uses[every], kind="stable")
        stays = np.zeros(len(every), bool)
        stays[often[np.cumsum(cost[often]) <= _CACHE_BYTES // 2]] = True
        stays &= uses[every] > 1
        self._reset()
        fixed = len(self.pieces)
        for table, words, at, keep in zip((self.pieces, self.units), names, rows, np.split(stays, [len(rows[0])]), strict=True):
            if table is self.pieces:
                keep[:fixed] = False  # the special tokens are there again
            at = at[keep]
            sizes = offsets[at + 1] - offsets[at]
            base = self._add(flat[span_index(offsets[at], sizes)], sizes)
            kept = [words[i] for i in np.flatnonzero(keep).tolist()]
            table.update(zip(kept, range(base, base + len(kept))))
            self.uses[base : base + len(kept)] = uses[at] // 2
            self.held += sum(map(len, kept))

    def _add(self, flat: np.ndarray, sizes: np.ndarray) -> int:
        """Append lists of ids, in arrays that double; returns the number of the first."""
        base, used = self.rows, int(self.offsets[self.rows])
        self.rows += len(sizes)
        if used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[:used], np.zeros(max(len(flat), len(self.flat)), np.int32)])
        if self.rows >= len(self.offsets):
            more = np.zeros(max(len(sizes), len(self.offsets)), np.int64)
            self.offsets, self.uses = np.concatenate([self.offsets[: base + 1], more]), np.concatenate([self.uses[: base + 1], more])
        self.flat[used : used + len(flat)] = flat
        self.offsets[base + 1 : self.rows + 1] = used + np.cumsum(sizes)
        self.held += 4 * len(flat) + _ENTRY_BYTES * len(sizes)
        return base

    def _ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.uses[: self.rows] += np.bincount(at, minlength=self.rows)
        sizes = self.offsets[at + 1] - self.offsets[at]
        return self.flat[span_index(self.offsets[at], sizes)], sizes

    def _merge(self, raw: list[bytes]) -> np.ndarray:
        """Add the ids of pieces; returns the number of each."""
        self.held += sum(map(len, raw))
        numbers = np.zeros(len(raw), np.int64)
        place = self.lexicon.find(raw) if self.lexicon else np.full(len(raw), -1)
        known, other = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        if len(known):
            begins, ends = (np.asarray(self.lexicon.offsets[place[known] + k]).astype(np.int64) for k in (0, 1))
            numbers[known] = self._add(np.asarray(self.lexicon.ids)[span_index(begins, ends - begins)], ends - begins) + np.arange(len(known))
        if len(other):
            numbers[other] = self._add(*self.merges.words([raw[i] for i in other.tolist()] if len(known) else raw)) + np.arange(len(other))
        return numbers

    def _learn_pieces(self, new: list[str]) -> None:
        self.pieces.update(zip(new, self._merge([w.encode() for w in new]).tolist(), strict=True))

    def _learn_units(self, new: list[str]) -> None:
        # A unit of letters alone is one piece with its space, whatever the splitting pattern's other parts.
        alone = [u for u in new if u.isalpha()]
        if alone:
            self.units.update(zip(alone, self._merge([b" " + u.encode() for u in alone]).tolist(), strict=True))
            new = [u for u in new if not u.isalpha()]
            if not new:
                return
        # Units never join, so one split serves all; their lengths tell where each ends.
        split = self.split(" " + " ".join(new))
        missing = list(set(split).difference(self.pieces))
        if missing:
            self._learn_pieces(missing)
        ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        units = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)) + 1)
        ids, sizes = self._ids(np.fromiter(map(self.pieces.__getitem__, split), np.int64, len(split)))
        total = np.concatenate([[0], np.cumsum(sizes)])
        edge = np.concatenate([[0], np.searchsorted(ends, units) + 1])
        base = self._add(ids, np.diff(total[edge]))
        self.units.update(zip(new, range(base, base + len(new)), strict=True))
        self.held += sum(map(len, new))

    def _pieces(self, text: str) -> list[str]:
        if self.specials is None or not any(t in text for t in self.merges.special):
            return self.split(text)
        out: list[str] = []
        for part in self.specials.split(text):
            out += ["\0" + part] if part in self.merges.special else self.split(part)
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of each text's ids.

        Where no white space touches other white space, a text falls at its spaces into units that the
        splitting pattern never joins, so whole units are looked up. Other texts are split in pieces.
        """
        if self.held > _CACHE_BYTES:
            self._shrink()
        heads: list[list[str]] = []
        tails: list[list[str]] = []
        for text in texts:
            if not text:
                heads.append([])
                tails.append([])
            elif text[0].isspace() or text[-1].isspace() or self.touching(text) or any(t in text for t in self.merges.special):
                heads.append(self._pieces(text))
                tails.append([])
            else:
                first, *rest = text.split(" ")
                heads.append(self.split(first))
                tails.append(rest)
        new = set(chain.from_iterable(heads)).difference(self.pieces)
        if new:
            self._learn_pieces(list(new))
        new = set(chain.from_iterable(tails)).difference(self.units)
        if new:
            self._learn_units(list(new))
        counts = np.array([len(h) + len(t) for h, t in zip(heads, tails, strict=True)], np.int64)
        pieces, units = self.pieces.__getitem__, self.units.__getitem__
        numbers = chain.from_iterable(chain(map(pieces, h), map(units, t)) for h, t in zip(heads, tails, strict=True))
        ids, sizes = self._ids(np.fromiter(numbers, np.int64, int(counts.sum())))
        total = np.concatenate([[0], np.cumsum(sizes)])
        edge = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(total[edge])


@lru_cache(maxsize=2)
def encoder(path: str, lexicon: str | None) -> Encoder:
    """One encoder for each Python worker and lexicon; tasks after the first reuse it."""
    return Encoder(path, Lexicon(SparkFiles.get(lexicon)) if lexicon else None)


# ---- operators -------------------------------------------------------------


#: Longer words, in bytes, are no candidates for a lexicon: texts without blanks are not words. They are merged like any unseen word.
LONGEST = 256


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words of at most LONGEST bytes; a task holds ``_CACHE`` of them, so some 100 MB, before it hands them on."""
    counts: Counter[bytes] = Counter()

    def rows() -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for _, _, data, _ in text_slices(batch):
            words = data.tobytes().split()
            if max(map(len, words), default=0) > LONGEST:
                words = [w for w in words if len(w) <= LONGEST]
            counts.update(words)
            if len(counts) > _CACHE:
                yield rows()
                counts.clear()
    yield rows()


def frequent_words(docs: DataFrame, limit: int = 1 << 16) -> list[bytes]:
    """The most frequent words between white space of at most LONGEST bytes, ``limit`` at most, counted over all rows.

    Counts are bucketed by their logarithm (under 400 buckets), and whole buckets are taken from
    the top while they fit, so no task sends the driver more than what is kept.
    """
    small_batches(docs.sparkSession)
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count_words, "word binary, n long")
    words = materialize(counted.groupBy("word").agg(F.sum("n").alias("n")).withColumn("bucket", F.floor(F.log2("n") * 6).cast("int")), "words")
    room, least = limit, None
    for row in words.groupBy("bucket").count().orderBy(F.desc("bucket")).collect():
        if row["count"] > room:
            break
        room, least = room - row["count"], row["bucket"]
    if least is None:
        return []
    return sorted(bytes(r.word) for r in words.where(F.col("bucket") >= least).select("word").collect())


def build_lexicon(spark: SparkSession, docs: DataFrame, path: str, limit: int = 1 << 16) -> str:
    """Compile the pieces of the most frequent words and hand the file to every executor; returns its name.

    The driver holds ``limit`` words of LONGEST bytes at most, however large the corpus. The file goes to the
    shared scratch folder through Spark's file system, and from there to executors, late ones too.
    """
    split = regex.compile(PATTERN).findall
    pieces = {p.encode() for w in frequent_words(docs, limit) for p in split(" " + w.decode("utf-8", "replace"))}
    blob = compile_words(pieces, merges(path).word)
    name = f"lexicon-{hashlib.sha256(blob).hexdigest()[:24]}.bin"
    base = scratch_path(spark, "lexicon")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(blob))
    out.close()
    if name not in _ADDED.setdefault(spark.sparkContext.applicationId, set()):
        spark.sparkContext.addFile(target.toString())
        _ADDED[spark.sparkContext.applicationId].add(name)
    return name


_ADDED: dict[str, set[str]] = {}


def _encode_rows(path: str, lexicon: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, lexicon)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            carried = batch.column(batch.schema.get_field_index("carried"))
            for lo, hi, _, _ in text_slices(batch):
                ids, sizes = coder.encode(texts[lo:hi].to_pylist())
                yield pa.record_batch([carried[lo:hi], list_array(ids, sizes, pa.int32())], names=["carried", "ids"])

    return run


def encode(docs: DataFrame, path: str, lexicon: str | None = None) -> DataFrame:
    """Token ids of every whole text: (carried, ids), where carried is a struct of all columns but text.

    Equal to the tokenizers library with the same file and add_special_tokens=False: the end
    token's own spelling in a text is that token. A null or empty text has no ids. Columns of
    any name pass through in ``carried``; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != "text"]
    flat = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("carried"), F.col("text").cast("string").alias("text"))
    return flat.mapInArrow(_encode_rows(path, lexicon), f"carried {flat.schema['carried'].dataType.simpleString()}, ids array<int>")


def _decode_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merges(path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            texts = [table.decode(np.asarray(x.values)).decode("utf-8", "replace") if x.is_valid else "" for x in ids]
            yield pa.record_batch([batch.column(batch.schema.get_field_index("carried")), pa.array(texts, pa.string())], names=["carried", "decoded"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(carried, decoded) for rows with ``ids`` (array<int>) and a struct ``carried``; null ids decode to an empty text."""
    small_batches(encoded.sparkSession)
    flat = encoded.select("carried", "ids")
    return flat.mapInArrow(_decode_rows(path), f"carried {flat.schema['carried'].dataType.simpleString()}, decoded string")


def _round_trip_rows(path: str, lexicon: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, table = encoder(path, lexicon), merges(path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            carried = batch.column(batch.schema.get_field_index("carried"))
            for lo, hi, _, _ in text_slices(batch):
                ids, sizes = coder.encode(texts[lo:hi].to_pylist())
                ends = np.cumsum(sizes)
                decoded = [table.decode(ids[b - n : b]).decode("utf-8", "replace") for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.record_batch([carried[lo:hi], list_array(ids, sizes, pa.int32()), pa.array(decoded, pa.string())], names=["carried", "ids", "decoded"])

    return run


def round_trip(docs: DataFrame, path: str, lexicon: str | None = None) -> DataFrame:
    """(carried, ids, decoded): ``encode``, and ``decode`` of its ids, in one pass, so that ids are not sent to Python again.

    Nulls, empty tables, repeated rows and columns of any name are as in ``encode``.
    """
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != "text"]
    flat = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("carried"), F.col("text").cast("string").alias("text"))
    return flat.mapInArrow(_round_trip_rows(path, lexicon), f"carried {flat.schema['carried'].dataType.simpleString()}, ids array<int>, decoded string")


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    """Round trip of every document through byte_bpe_50k.

    A null text is encoded as an empty one (no tokens); repeated rows, and rows without an id, are each returned; other columns of
    documents are ignored; an empty table gives no rows.
    """
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    coded = round_trip(docs, path, build_lexicon(spark, docs, path))
    return coded.select("carried.doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


__all__ = ["Encoder", "Lexicon", "Merges", "build_lexicon", "compile_words", "decode", "encode", "frequent_words", "op1_bpe", "round_trip"]
