"""Byte-level BPE encoding and decoding.

Pre-tokenisation uses no regular expression: code points are looked up in a class array, each class is
a transition function of a small automaton, and an associative scan over function composition gives the
state before every code point, from which piece starts follow. Pieces then go through cached pair
merging by rank; byte offsets of the tokens are retained for decoding.

Edge cases: a null text counts as empty (no ids); an empty table gives an empty result; repeated rows
give repeated results; columns of the input besides the two named ones are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, mapped, table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Pieces beyond which a worker's cache starts anew with the next chunk.
CACHE = 500_000
NEVER = 1 << 30
#: Code points with the White_Space property.
WHITE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]

#: Letters and numbers that Unicode 16 adds to Python's tables.
LATER_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
LATER_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]

# classes of code points; the last of a run of white space is told from the others
END, LETTER, NUMBER, OTHER, QUOTE, ONE, PAIR, SPACE, SPACE_LAST, BLANK, BLANK_LAST = range(11)
# states: what the piece so far is; FRESH: none, QUOTED: a quote that begins a piece, HALF: one letter of 're, 've or 'll is to come
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, AFTER_BLANK, IN_BLANKS, QUOTED, HALF = range(9)


def step(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether a piece starts here."""
    if kind == END:
        return FRESH, False
    if kind in (SPACE, BLANK):
        return IN_BLANKS, state != IN_BLANKS
    if kind == SPACE_LAST:
        return AFTER_SPACE, True
    if kind == BLANK_LAST:
        return AFTER_BLANK, True
    if kind in (LETTER, ONE, PAIR):
        if state == HALF:
            return FRESH, False
        if state == QUOTED and kind != LETTER:
            return (FRESH if kind == ONE else HALF), False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_SPACE)
    if kind == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_SPACE)
    goes_on = state in (IN_OTHERS, AFTER_SPACE, QUOTED)
    return (QUOTED if kind == QUOTE and not goes_on else IN_OTHERS), not goes_on


@functools.cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each class its function, the table of compositions (first, then), the table of applications, piece starts by state and class."""
    of_class = [tuple(step(s, k)[0] for s in range(9)) for k in range(11)]
    found = dict.fromkeys([tuple(range(9)), *of_class])
    todo = list(found)
    while todo:
        f = todo.pop()
        for g in of_class:
            for h in (tuple(g[s] for s in f), tuple(f[s] for s in g)):
                if h not in found:
                    found[h] = None
                    todo.append(h)
    at = {f: i for i, f in enumerate(found)}
    table = np.array(list(found), np.uint8)
    composed = np.array([[at[tuple(g[s] for s in f)] for g in found] for f in found], np.uint16)
    starts = np.array([[step(s, k)[1] for k in range(11)] for s in range(9)])
    return np.array([at[f] for f in of_class], np.uint16), composed, table, starts


def scanned(functions: np.ndarray, width: int = 128) -> np.ndarray:
    """The inclusive scan of the functions under composition: blocks side by side, then the blocks' totals in the same way."""
    _, composed, _, _ = monoid()
    size, n = len(composed), len(functions)
    flat = composed.ravel()
    if n <= width:
        out, f = np.empty(n, np.uint16), 0
        for i, g in enumerate(functions.tolist()):
            out[i] = f = composed[f, g]
        return out
    rows = -(-n // width)
    lanes = np.zeros(rows * width, np.uint16)  # 0 is the identity
    lanes[:n] = functions
    lanes = np.ascontiguousarray(lanes.reshape(rows, width).T)
    for i in range(1, width):
        lanes[i] = flat[lanes[i - 1].astype(np.int32) * size + lanes[i]]
    before = np.concatenate([[0], scanned(lanes[-1], width)[:-1]]).astype(np.int32)
    return flat[before * size + lanes].T.ravel()[:n]


@functools.cache
def kinds() -> np.ndarray:
    """Class by code point."""
    letters = {"L": LETTER, "N": NUMBER}
    out = np.array([letters.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    for first, last in LATER_LETTERS:
        out[first : last + 1] = LETTER
    for first, last in LATER_NUMBERS:
        out[first : last + 1] = NUMBER
    out[WHITE] = BLANK
    out[32], out[39] = SPACE, QUOTE
    return out


def boundaries(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined, their code points, where pieces start or texts end, and which of these are ends of texts."""
    joined = "\0".join([*texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(x) + 1 for x in texts]) - 1
    kind = kinds()[points]
    # letters are told apart only behind a quote
    behind = np.flatnonzero(kind[:-1] == QUOTE) + 1
    letter, follow = points[behind], points[np.minimum(behind + 1, len(points) - 1)]
    kind[behind[np.isin(letter, [ord(c) for c in "stmd"])]] = ONE
    kind[behind[((letter == ord("r")) | (letter == ord("v"))) & (follow == ord("e")) | (letter == ord("l")) & (follow == ord("l"))]] = PAIR
    kind[ends] = END
    white = (kind == SPACE) | (kind == BLANK)
    last = white.copy()
    last[:-1] &= ~white[1:] & (kind[1:] != END)
    last[-1:] = False
    kind += last  # SPACE_LAST follows SPACE, BLANK_LAST follows BLANK
    of_class, _, applied, starts = monoid()
    state = applied[:, FRESH][scanned(of_class[kind])]
    begins = np.empty(len(kind), bool)
    begins[:1] = starts[FRESH, kind[:1]]
    begins[1:] = starts.ravel()[state[:-1] * np.uint8(starts.shape[1]) + kind[1:]]
    begins[ends] = True
    bounds = np.flatnonzero(begins)
    return joined, points, bounds, kind[bounds] == END


#: Of 8 bytes the first 0 to 8.
FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Bytes of a piece that the table holds; longer ones are looked up as they are.
WIDE = 32


class Table:
    """Pieces of up to WIDE bytes, as rows of words of 8 bytes and the size, and their ids: open addressing, looked up and filled by whole arrays."""

    def __init__(self) -> None:
        self.size = 0
        self.slots = np.full(1 << 16, -1, np.int32)
        self.words = np.zeros((1024, 5), np.uint64)
        self.begin, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(4096, np.int32), 0

    @staticmethod
    def rows(data: bytes, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        view = np.ndarray((len(data) + 1,), "<u8", buffer=data + bytes(WIDE + 8), strides=(1,))
        out = np.zeros((len(begin), 5), np.uint64)
        out[:, 4] = size
        for i in range(4):
            some = slice(None) if i == 0 else np.flatnonzero(size > 8 * i)
            out[some, i] = view[begin[some] + 8 * i] & FIRST_BYTES[np.minimum(size[some] - 8 * i, 8)]
        return out

    def places(self, words: np.ndarray) -> np.ndarray:
        key = words[:, 4].copy()
        for i in range(4):
            key = (key ^ words[:, i]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return (key & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, words: np.ndarray) -> np.ndarray:
        """The slot of each row, -1 for new ones."""
        out = np.full(len(words), -1, np.int64)
        todo, at = np.arange(len(words)), self.places(words)
        while len(todo):
            slot = self.slots[at]
            full = slot >= 0
            todo, at, slot = todo[full], at[full], slot[full]
            same = (self.words[slot] == words[todo]).all(axis=1)
            out[todo[same]] = slot[same]
            todo, at = todo[~same], (at[~same] + 1) & (len(self.slots) - 1)
        return out

    def add(self, words: np.ndarray, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Slots for new, different rows with their ids."""
        n = len(words)
        for name, used, more in (("words", self.size, words), ("begin", self.size, self.used + np.cumsum(count) - count), ("count", self.size, count), ("flat", self.used, ids)):
            own = getattr(self, name)
            if used + len(more) > len(own):
                grown = np.zeros((2 * (used + len(more)), *own.shape[1:]), own.dtype)
                grown[:used] = own[:used]
                setattr(self, name, own := grown)
            own[used : used + len(more)] = more
        slot = np.arange(self.size, self.size + n)
        self.size, self.used = self.size + n, self.used + len(ids)
        if 2 * self.size > len(self.slots):
            self.slots = np.full(1 << (4 * self.size - 1).bit_length(), -1, np.int32)
            self.place(np.arange(self.size))
        else:
            self.place(slot)
        return slot

    def place(self, todo: np.ndarray) -> None:
        at = self.places(self.words[todo])
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            lost = self.slots[at] != todo  # the place was full, or another row took it
            todo, at = todo[lost], (at[lost] + 1) & (len(self.slots) - 1)


def unlike(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each kind of row, and of each row its kind."""
    order = np.lexsort(words.T)
    own = words[order]
    new = np.concatenate([[True], (own[1:] != own[:-1]).any(axis=1)])[: len(order)]
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    return order[new], kind


class Pieces:
    """Texts to ids by way of a table of pieces; what the table lacks goes to encode_pieces()."""

    most = CACHE

    def __init__(self) -> None:
        self.forget()

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, and how many each has."""
        raise NotImplementedError

    def forget(self) -> None:
        """Frees the cache: a worker process outlives its task, and later stages need the memory."""
        self.table: Table | None = None
        self.long: dict[bytes, int] = {}

    def slots_of(self, data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The slot of each slice of data."""
        if self.table is None or self.table.size > self.most:
            self.forget()
            self.table = Table()
        table, size = self.table, end - begin
        out = np.empty(len(size), np.int64)
        short = np.flatnonzero(size <= WIDE)
        words = table.rows(data, begin[short], size[short])
        slots = table.find(words)
        new = np.flatnonzero(slots < 0)
        if len(new):
            first, kind = unlike(words[new])
            some = short[new[first]]
            slots[new] = table.add(words[new[first]], *self.encode_pieces([data[a:b] for a, b in zip(begin[some].tolist(), end[some].tolist())]))[kind]
        out[short] = slots
        for i in np.flatnonzero(size > WIDE).tolist():
            piece = data[begin[i] : end[i]]
            if (slot := self.long.get(piece)) is None:
                ids, count = self.encode_pieces([piece])
                # a row that no short piece has
                slot = self.long[piece] = int(table.add(np.array([[len(self.long), 0, 0, 0, WIDE + 1]], np.uint64), ids, count)[0])
            out[i] = slot
        return out

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where those of each text begin, and the end."""
        if not texts:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        joined, points, bounds, is_end = boundaries(texts)
        data = joined.encode("utf-8", "surrogatepass")
        at = np.append(bounds, len(joined))
        place = at if len(data) == len(joined) else np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])[at]
        piece = np.flatnonzero(~is_end)
        slot = self.slots_of(data, place[piece], place[piece + 1])
        count = self.table.count[slot]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.table.flat[np.arange(int(total[-1])) + np.repeat(self.table.begin[slot] - total[:-1], count)]
        # pieces up to the end of each text
        return ids, np.concatenate([[0], total[np.cumsum(~is_end)[is_end]]])

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, cuts = self.encode_flat(texts)
        return [ids[a:b].tolist() for a, b in itertools.pairwise(cuts.tolist())]


class Joins:
    """Ranks by pairs of ids."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray):
        self.mask = (1 << (2 * len(pairs) - 1).bit_length()) - 1
        self.keys, self.ranks = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, NEVER, np.int32)
        at = self.places(pairs)
        while len(pairs):
            free = self.keys[at] < 0
            self.keys[at[free]] = pairs[free]
            won = self.keys[at] == pairs
            self.ranks[at[won]] = ranks[won]
            pairs, ranks, at = pairs[~won], ranks[~won], (at[~won] + 1) & self.mask

    def places(self, pairs: np.ndarray) -> np.ndarray:
        key = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((key ^ key >> np.uint64(29)) & np.uint64(self.mask)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs = left.astype(np.int64) << 32 | right
        at = self.places(pairs)
        out = np.where((found := self.keys[at]) == pairs, self.ranks[at], NEVER)
        todo = np.flatnonzero((found != pairs) & (found >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            found = self.keys[at[todo]]
            hit = found == pairs[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out


class Codec(Pieces):
    """Encodes and decodes by a file of ranks."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        most = max(self.ranks.values()) + 1
        self.bytes = [b""] * most
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.text = [str(i) for i in range(most)]
        self.sizes = np.array([len(x) for x in self.bytes])
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        # every way to join two tokens to a third, by the pair; the third's id is its rank
        pairs = [(self.ranks[token[:i]] << 32 | self.ranks[token[i:]], rank) for token, rank in self.ranks.items() for i in range(1, len(token)) if token[:i] in self.ranks and token[i:] in self.ranks]
        self.pairs = Joins(*(np.array(x, np.int64) for x in zip(*pairs)))

    def short(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As merged(), for many pieces at once: in each round every piece that has a pair left joins its least one, the leftmost among equals."""
        part = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), np.fromiter(map(len, pieces), np.int64, len(pieces)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(part), NEVER, np.int64)
        near = np.flatnonzero(owner[1:] == owner[:-1])
        rank[near] = self.pairs.find(part[near], part[near + 1])
        while len(part):
            start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            size = np.diff(np.append(start, len(part)))
            least = np.minimum.reduceat(rank, start)
            live = least < NEVER
            if not live.all():
                rest = np.repeat(live, size)
                done.append((owner[~rest], part[~rest]))
                part, owner, rank = part[rest], owner[rest], rank[rest]
                start, size, least = np.cumsum(size[live]) - size[live], size[live], least[live]
                if not len(part):
                    break
            hits = np.flatnonzero(rank == np.repeat(least, size))
            at = hits[np.concatenate([[True], owner[hits[1:]] != owner[hits[:-1]]])]  # the first of each piece
            part[at] = least
            keep = np.ones(len(part), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # places after those before have lost a part each
            part, owner, rank = part[keep], owner[keep], rank[keep]
            # the pairs of the new part, with the ones before and behind it
            for left in (at - 1, at):
                inside = (left >= 0) & (left + 1 < len(part))
                some = left[inside]
                same = owner[some] == owner[some + 1]
                rank[some[same]] = self.pairs.find(part[some[same]], part[some[same] + 1])
            last = np.append(owner[1:] != owner[:-1], True)
            rank[last] = NEVER
        owner, part = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        order = np.argsort(owner, kind="stable")
        return part[order].astype(np.int32), np.bincount(owner, minlength=len(pieces))

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Pairs merged in order of rank, the leftmost first among equals; a heap keeps long pieces from taking quadratic time."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        n = len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            middle = end[i]
            if middle <= i or middle >= n or end[middle] != to:
                continue  # one of the two has been merged since
            end[i], end[middle] = to, -1
            if to < n:
                before[to] = i
                if (r := ranks.get(piece[i : end[to]])) is not None:
                    heapq.heappush(heap, (r, i, end[to]))
            if (j := before[i]) >= 0 and (r := ranks.get(piece[j:to])) is not None:
                heapq.heappush(heap, (r, j, to))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(pieces) == 1:
            ids = self.merged(pieces[0])
            return np.array(ids, np.int32), np.array([len(ids)])
        # a piece that is a token is that one, even if no pairs lead to it
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int32, len(pieces))
        rest = np.flatnonzero(whole < 0)
        count = np.ones(len(pieces), np.int64)
        flat, count[rest] = self.short([pieces[i] for i in rest.tolist()])
        out = np.empty(int(count.sum()), np.int32)
        place = np.repeat(whole >= 0, count)
        out[place], out[~place] = whole[whole >= 0], flat
        return out, count

    def offsets(self, ids: list[int] | np.ndarray) -> np.ndarray:
        """Where each token starts in the encoded text, in bytes, and its end."""
        return np.concatenate([[0], np.cumsum(self.sizes[np.asarray(ids, np.int64)])])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


def encode(df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>, offsets array<long>): of each text its token ids, and where each token starts in the UTF-8 text and the last one ends."""
    path = path or default_path()
    one = df.select(F.col(key), F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for part, texts in chunks(batches):
            ids, cuts = own.encode_flat(texts)
            # each text has one offset more than ids
            places = np.concatenate([np.zeros(0, np.int64), *(own.offsets(ids[a:b]) for a, b in itertools.pairwise(cuts.tolist()))])
            offsets = pa.ListArray.from_arrays(pa.array((cuts + np.arange(len(cuts))).astype(np.int32)), pa.array(places))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids)), offsets], names=[key, "ids", "offsets"])
        own.forget()

    return one.transform(mapped, run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>, offsets array<bigint>")


def decode(df: DataFrame, path: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded binary): the bytes of each array of ids; null ids count as none."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            out = [own.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[key, "decoded"])

    return df.select(F.col(key), F.col(ids).alias("_ids")).transform(mapped, run, f"`{key}` {df.schema[key].dataType.simpleString()}, decoded binary")


def digests(df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_bytes, ids_sha256, decoded_sha256): each text encoded, its ids decoded again, and both digested, in one pass."""
    path = path or default_path()
    one = df.select(F.col(key), F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for part, texts in chunks(batches):
            counts, sizes, ids_sha, decoded_sha = [], [], [], []
            for ids in own.encode(texts):
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(own.text.__getitem__, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(whole := own.decode(ids)).hexdigest())
                sizes.append(len(whole))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=[key, "n_tokens", "n_bytes", "ids_sha256", "decoded_sha256"])
        own.forget()

    return one.transform(mapped, run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens bigint, n_bytes bigint, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
