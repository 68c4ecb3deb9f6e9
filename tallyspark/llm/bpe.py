"""Byte-level BPE encoding and decoding as streaming transducers.

Encoding: merges move what was decided about a text's left part only by chains of ever later rules, each of which takes
the token that ends where the last one began. The longest such chain of a merge list bounds how far back new input can
reach; a token that ends further back than this is final, so an encoder with a window of that length plus one token
can emit it and forget it. Decoding: a byte-to-text state machine that keeps at most an unfinished character.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import ship, table


#: Code points that are split at once, and those of the longest pre-token that is remembered.
_BLOCK, _LONG = 1 << 20, 64
_MULTIPLIER = 0x9E3779B97F4A7C15


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [letters[b] for b in range(256)]


class KeyTable:
    """Numbers 64-bit keys in the order in which they are added; open addressing in an array of at most half as many keys."""

    def __init__(self):
        self.bits, self.keys = 10, np.zeros(0, np.uint64)
        self.slots = np.full(1 << self.bits, -1, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(_MULTIPLIER)) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number, -1 where it is not held."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        slot = self._slot(keys)
        out = self.slots[slot].astype(np.int64)
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            out[open_] = self.slots[slot[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[out[open_]] != keys[open_])]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Hold further keys, of which the first of equal ones counts; the keys must not be held yet."""
        old = len(self.keys)
        self.keys = np.concatenate([self.keys, keys])
        if 2 * len(self.keys) > len(self.slots):
            self.bits = max(self.bits, (2 * len(self.keys)).bit_length())
            self.slots, old = np.full(1 << self.bits, -1, np.int32), 0
        waiting = np.arange(len(self.keys) - 1, old - 1, -1)  # backwards, as the last to claim a slot gets it
        slot = self._slot(self.keys[waiting])
        while len(waiting):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = waiting[free]
            lost = self.keys[self.slots[slot]] != self.keys[waiting]
            waiting, slot = waiting[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)


class Merges:
    """A merge list: pairs of token ids by rank, with the encoder's window."""

    def __init__(self, first: list[int], pairs: list[tuple[int, int, int]], widths: dict[int, int]):
        """first: the id of each byte; pairs: left, right and merged id by rank; widths: bytes of each id."""
        self.first = first
        self.rule = {(a, b): (r, c) for r, (a, b, c) in reversed([*enumerate(pairs)])}
        self.widths = widths
        self.widest = max(widths.values())
        self.lookahead = self._reach(pairs)
        self.base = max(widths) + 1
        keys = np.array([a * self.base + b for a, b, _ in pairs], np.int64)
        self.rules = KeyTable()
        self.rules.add(keys.view(np.uint64))
        self.made = np.array([c for _, _, c in pairs], np.int64)
        self.window = self.lookahead + max(4 * self.widest, 256)

    def _reach(self, pairs) -> int:
        """Bytes that input can reach back: the heaviest chain of rules of growing rank, in which the left token of each
        begins the right token of the next."""
        head: dict[int, int] = {}
        best: dict[int, int] = {}
        most = 0
        for a, b, c in pairs:
            far, s = 0, b
            while s is not None:
                far, s = max(far, best.get(s, 0)), head.get(s)
            far += self.widths[a]
            best[a] = max(best.get(a, 0), far)
            head.setdefault(c, a)
            most = max(most, far)
        return most

    def merged(self, ids: list[int]) -> list[int]:
        """The ids after all merges; quadratic, so only for a window's length."""
        rule = self.rule
        while len(ids) > 1:
            found = [rule[p] for p in zip(ids, ids[1:]) if p in rule]  # noqa: B905
            if not found:
                break
            rank, new = min(found)
            out, i, last = [], 0, len(ids) - 1
            while i <= last:
                if i < last and (hit := rule.get((ids[i], ids[i + 1]))) and hit[0] == rank:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Ids of a pre-token that arrives in chunks; holds one window of bytes."""
        kept = b""
        for chunk in chunks:
            for at in range(0, len(chunk), self.window):
                kept += chunk[at : at + self.window]
                while len(kept) >= self.window:
                    done = 0
                    for t in self.merged([self.first[b] for b in kept[: self.window]]):
                        if done + self.widths[t] > self.window - self.lookahead:
                            break
                        done += self.widths[t]
                        yield t
                    kept = kept[done:]
        yield from self.merged([self.first[b] for b in kept])

    def _symbols(self, words: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """The ids of all bytes of words of these sizes, before any merge."""
        return np.array(self.first, np.int64)[np.frombuffer(b"".join(words), np.uint8)]

    def encode_flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """stream() of each word, end to end, and how many ids each has; words that fit into a window pass through it
        side by side, a rule at a time each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        done = []
        for i in np.flatnonzero(sizes >= self.window).tolist():
            long = np.fromiter(self.stream([words[i]]), np.int64)
            done.append((np.full(len(long), i), long))
        fit = np.flatnonzero((sizes > 0) & (sizes < self.window))
        ids = self._symbols([words[i] for i in fit.tolist()], sizes[fit])
        of = np.repeat(fit, sizes[fit])
        none = len(self.made)
        while len(ids):
            rank = np.full(len(ids), none)
            found = self.rules.find((ids[:-1] * self.base + ids[1:]).view(np.uint64))
            rank[:-1] = np.where((found >= 0) & (of[:-1] == of[1:]), found, none)
            starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            least = np.minimum.reduceat(rank, starts)
            best = np.repeat(least, np.diff(np.append(starts, len(ids))))
            open_ = best < none
            done.append((of[~open_], ids[~open_]))
            merge = np.flatnonzero(open_ & (rank == best))
            if len(merge):  # of rules that overlap (a token met twice over), the first of each two holds
                fresh = np.concatenate([[True], np.diff(merge) != 1])
                nth = np.arange(len(merge)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
                merge = merge[nth % 2 == 0]
            ids[merge] = self.made[rank[merge]]
            open_[merge + 1] = False
            ids, of = ids[open_], of[open_]
        of, ids = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*done, strict=True) if done else ((), ())))
        return ids[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(words))

    def encode_many(self, words: list[bytes]) -> list[list[int]]:
        """encode_flat() as lists."""
        flat, sizes = self.encode_flat(words)
        ends = np.cumsum(sizes)
        return [flat[b - n : b].tolist() for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


class Tokens:
    """Tables of ids: the bytes that each stands for, and the text of its decimal digits with a comma."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = self._packed(pieces)
        self.digits = self._packed([b"%d," % i for i in range(len(pieces))])

    @staticmethod
    def _packed(pieces: list[bytes]):
        sizes = np.array([len(p) for p in pieces], np.int64)
        return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes, sizes

    @staticmethod
    def joined(packed, ids: np.ndarray) -> bytes:
        data, at, sizes = packed
        n = sizes[ids]
        ends = np.cumsum(n)
        return data[np.repeat(at[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


class TextDecoder:
    """Ids to text, a piece at a time; an unfinished character waits for its bytes. Bytes that form none give U+FFFD."""

    def __init__(self, tokens: Tokens):
        self.tokens, self.state = tokens, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        return self.state.decode(Tokens.joined(self.tokens.pieces, ids))

    def finish(self) -> str:
        return self.state.decode(b"", True)


# Classes of characters for the splitting pattern.
_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
# Unicode's White_Space, and the suffixes that the pattern splits after an apostrophe.
_SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(0x110000)], np.uint8)
    out[_SPACES] = _SPACE
    return out


def split_points(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin, in the code points of texts laid end to end, whose own beginnings are given.

    Does what the pattern `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+` does, by
    comparing neighbours.
    """
    n = len(points)
    kind = _classes()[points]
    space = kind == _SPACE
    opens = np.zeros(n + 1, bool)
    opens[begins] = True
    opens[n] = True
    first = opens[:-1]
    before = np.empty(n, np.uint8)
    before[0], before[1:] = _OTHER, kind[:-1]
    after_space = np.zeros(n, bool)
    after_space[1:] = space[:-1]
    after_blank = np.zeros(n, bool)
    after_blank[1:] = points[:-1] == 32
    next_solid = np.zeros(n, bool)
    next_solid[:-1] = ~space[1:]
    next_solid &= ~opens[1:]
    start = np.where(
        space,
        ~after_space | next_solid,
        np.where(after_space, ~after_blank, kind != before),
    )
    start |= first
    for i in np.flatnonzero(start & (points == 39)).tolist():
        for suffix in _SUFFIXES:
            end = i + 1 + len(suffix)
            if end <= n and not opens[i + 1 : end].any() and all(points[i + 1 + k] == ord(c) for k, c in enumerate(suffix)):
                start[i + 1 : end] = False
                if end < n:
                    start[end] = True
                break
    return np.flatnonzero(start)


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    out = []
    for base in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return tuple(out)


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... count[i] times, for all i."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


class _Memory:
    """Ids of pre-tokens by a hash of their code points, which are kept to tell equal hashes apart."""

    def __init__(self):
        self.table = KeyTable()
        self.start, self.size, self.at, self.width = (np.zeros(0, np.int64) for _ in range(4))
        self.points, self.ids = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, points: np.ndarray, size: np.ndarray, ids: np.ndarray, width: np.ndarray) -> None:
        self.table.add(keys)
        self.start = np.concatenate([self.start, len(self.points) + np.cumsum(size) - size])
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(width) - width])
        self.size, self.width = np.concatenate([self.size, size]), np.concatenate([self.width, width])
        self.points, self.ids = np.concatenate([self.points, points]), np.concatenate([self.ids, ids])


class Encoder:
    """Encodes batches of texts. Short pre-tokens recur, so each passes the transducer once and is remembered.

    Texts go through in blocks of _BLOCK code points, cut where a pre-token begins; a pre-token longer than a block is
    streamed. So what is held besides a text does not grow with it.
    """

    REMEMBERED = 400_000

    def __init__(self, spec: dict, library=None):
        """spec: a byte-level tokenizer file's content. library: encode pre-tokens with it instead of the transducer."""
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        byte = {c: b for b, c in enumerate(letters)}
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        pieces = [b""] * size
        for token, i in vocab.items():
            pieces[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            pieces[i] = text.encode()
        pairs = []
        for m in spec["model"]["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            pairs.append((vocab[a], vocab[b], vocab[a + b]))
        self.merges = Merges([vocab[c] for c in letters], pairs, {i: len(p) for i, p in enumerate(pieces) if p})
        self.tokens = Tokens(pieces)
        self.memory = _Memory()
        self.flat = self._transduced if library is None else library

    def _transduced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.merges.encode_flat([w.encode() for w in words])

    def _words(self, whole: str, points: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens of a block, end to end, and how many each has."""
        n = len(points)
        power, inverse = _powers(1 << max(10, n.bit_length()))
        mixed = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed * power[:n], out=sums[1:])
        keys = (sums[starts + size] - sums[starts]) * inverse[starts]
        if len(self.memory.size) > self.REMEMBERED:
            self.memory = _Memory()
        memory = self.memory
        row = memory.table.find(keys)
        short = size <= _LONG
        miss = np.flatnonzero((row < 0) & short)
        if len(miss):
            new, first = np.unique(keys[miss], return_index=True)
            first = miss[first]
            ids, width = self.flat([whole[a:b] for a, b in zip(starts[first].tolist(), (starts + size)[first].tolist(), strict=True)])
            memory.add(new, points[_spread(starts[first], size[first])], size[first], ids, width)
            row[miss] = memory.table.find(keys[miss])
        known = row >= 0
        known[known] = memory.size[row[known]] == size[known]
        of = np.flatnonzero(known)
        here, there = _spread(starts[of], size[of]), _spread(memory.start[row[of]], size[of])
        if (points[here] != memory.points[there]).any():  # equal hashes of different pre-tokens
            differ = np.bincount(np.repeat(of, size[of]), points[here] != memory.points[there], len(known)) > 0
            known &= ~differ
        at, width = memory.at[row], memory.width[row]
        table_ = memory.ids
        other = np.flatnonzero(~known)
        if len(other):
            ids, wide = self.flat([whole[a:b] for a, b in zip(starts[other].tolist(), (starts + size)[other].tolist(), strict=True)])
            at[other], width[other] = len(table_) + np.cumsum(wide) - wide, wide
            table_ = np.concatenate([table_, ids])
        return table_[_spread(at, width)], width

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens, end to end, and how many each has."""
        sizes = np.array([len(t) for t in texts], np.int64)
        whole = "".join(texts)
        if not whole:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(sizes)
        starts = split_points(points, (ends - sizes)[sizes > 0])
        ids, width = self._words(whole, points, starts, np.diff(np.append(starts, len(points))))
        upto = np.concatenate([[0], np.cumsum(width)])[np.searchsorted(starts, np.concatenate([[0], ends]))]
        return ids, np.diff(upto)

    def _pieces(self, text: str, block: int) -> Iterator[np.ndarray]:
        """Ids of a text without special tokens, a block at a time. Where a pre-token begins within a block is certain
        up to a few code points before its end: the pattern looks no further ahead than "'re" and what follows it."""
        ahead, at, n = 8, 0, len(text)
        while n - at > block + ahead:
            piece = text[at : at + block + ahead]
            starts = split_points(np.frombuffer(piece.encode("utf-32-le"), np.uint32), np.zeros(1, np.int64))
            cut = int(starts[starts <= block][-1])
            if cut:
                yield self._plain([piece[:cut]])[0]
                at += cut
            else:
                end = self._end(text, at, block, ahead)
                chunks = (text[i : min(i + block, end)].encode() for i in range(at, end, block))
                ids = self.merges.stream(chunks)
                while len(some := np.fromiter(islice(ids, block), np.int64)):
                    yield some
                at = end
        if at < n:
            yield self._plain([text[at:]])[0]

    @staticmethod
    def _end(text: str, at: int, block: int, ahead: int) -> int:
        """Where the pre-token that begins at `at` ends, looking at a block of the text at a time."""
        i = at
        while i + block + ahead < len(text):
            i += block
            # With the code point before it, a block splits as the whole does, but for its very beginning.
            piece = text[i - 1 : i + block + ahead]
            starts = split_points(np.frombuffer(piece.encode("utf-32-le"), np.uint32), np.zeros(1, np.int64))
            starts = starts[(starts > 0) & (starts <= block + 1)]
            if len(starts):
                return i - 1 + int(starts[0])
        return len(text)

    def _parts(self, text: str) -> list[str | int]:
        """The text's plain parts and the ids of special tokens between them."""
        out: list[str | int] = [text]
        for content, i in self.special.items():
            split = []
            for part in out:
                if isinstance(part, str) and content in part:
                    for k, piece in enumerate(part.split(content)):
                        split += [i] * (k > 0) + [piece]
                else:
                    split.append(part)
            out = split
        return out

    def batches(self, texts: list[str | None], block: int = _BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
        """(index of the first text, ids, ids of each text, whether more of the last text follows) for runs of texts, in
        order. A text longer than a block comes in several runs of its own."""
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop] or "") <= block):
                size += len(texts[stop] or "")
                stop += 1
            run = [t or "" for t in texts[at:stop]]
            marked = any(c in t for c in self.special for t in run)
            if size <= block and not marked:
                yield (at, *self._plain(run), False)
            else:
                for k, t in enumerate(run):
                    held: list[np.ndarray] = []
                    for part in self._parts(t):
                        for ids in [np.array([part])] if isinstance(part, int) else self._pieces(part, block):
                            held.append(ids)
                            if sum(map(len, held)) >= block:
                                ids = np.concatenate(held)
                                yield at + k, ids, np.array([len(ids)], np.int64), True
                                held = []
                    ids = np.concatenate([np.zeros(0, np.int64), *held])
                    yield at + k, ids, np.array([len(ids)], np.int64), False
            at = stop


@lru_cache(2)
def encoder(content: bytes, by_library: bool = False) -> Encoder:
    """An encoder for a tokenizer file's content; kept by the worker."""
    return Encoder(json.loads(content), _library(content) if by_library else None)


def _library(content: bytes):
    """Encodes pre-tokens with the tokenizers library's model, which is what the library does with each of them."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_buffer(content).model
    letters = dict(enumerate(byte_letters()))

    def flat(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = [model.tokenize(w.encode().decode("latin-1").translate(letters)) for w in words]
        return np.array([t.id for c in coded for t in c], np.int64), np.fromiter(map(len, coded), np.int64, len(coded))

    return flat


class _Digest:
    """Digests of a text's ids and of what they decode to, fed a piece at a time."""

    def __init__(self, tokens: Tokens):
        self.n, self.digits, self.text, self.decoder = 0, hashlib.sha256(), hashlib.sha256(), TextDecoder(tokens)

    def feed(self, ids: np.ndarray, step: int = 1 << 16) -> None:
        for i in range(0, len(ids), step):
            piece = Tokens.joined(self.decoder.tokens.digits, ids[i : i + step])
            self.digits.update(b"," + piece[:-1] if self.n + i else piece[:-1])
            self.text.update(self.decoder.feed(ids[i : i + step]).encode())
        self.n += len(ids)

    def finish(self) -> tuple[int, str, str]:
        self.text.update(self.decoder.finish().encode())
        return self.n, self.digits.hexdigest(), self.text.hexdigest()


def _digests(content, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = encoder(content.value)
    for batch in batches:
        rows, now = [], _Digest(own.tokens)
        for _, ids, each, more in own.batches(batch.column("text").to_pylist()):
            at = 0
            for n in each.tolist():
                now.feed(ids[at : at + n])
                at += n
                if not more:
                    rows.append(now.finish())
                    now = _Digest(own.tokens)
        counts, by_ids, by_text = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array(counts, pa.int64()), pa.array(by_ids, pa.string()), pa.array(by_text, pa.string())],
            ["key", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def token_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 (of the decimal ids, comma-joined) and decoded_sha256 of every row of docs.

    path: a byte-level tokenizer file on the driver. A null text is empty and has no tokens. Rows are independent of
    each other, so repeated rows and null keys need no care. Texts of any length pass in blocks.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(path, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())  # a vocabulary file, of a few MB
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(
        lambda batches: _digests(content, batches), f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
    return out.withColumnRenamed("key", key)


def _coded(content, by_library: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = encoder(content.value, by_library)
    for batch in batches:
        ids, sizes = [], np.zeros(len(batch), np.int64)
        for at, part, each, _ in own.batches(batch.column("text").to_pylist()):
            ids.append(part.astype(np.int32))
            sizes[at : at + len(each)] += each
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.int32), *ids])
        coded = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("key"), coded], ["key", "ids"])


def encode_ids(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids (array of int) of every row; a null text has none."""
    spark = docs.sparkSession
    ship(spark)
    with open(path, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(lambda b: _coded(content, False, b), f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def op9_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token digests of all documents under the 50k byte-level vocabulary."""
    import public_tokenizers

    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
