"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers, run in lock step over many chunks of text at once:

* The splitter reads character classes and marks where the words of the byte-pair tokenizer begin. It has ten states; a
  chunk's state map (from any state before it to the state after it) is found for all states, and the chunks' maps are
  composed by a parallel prefix scan. Where a mark depends on the next character, it's placed when that is read.
* The merger reads bytes and emits on each transition the change in the number of tokens. Its states are compiled from
  the merge list when first met, and kept. By the prefix property of byte-pair merging (Berglund and van der Merwe
  2023), the last token of every prefix is unique, and it's the one whose junction with the token before merges no
  further. What can still matter after a prefix is a bounded tail of last tokens, so the states are finite.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotary.llm.common import table
from quotary.llm.shingles import binary, slices

#: More tokens than this are over the limit.
LIMIT = 1024
#: Characters of one block of text, and of one chunk of it.
BLOCK, CHUNK = 1 << 20, 512

#: Compiled states that are kept from one block to the next: about 150 MB.
MOST_STATES = 100_000

# Classes of characters: letter, number, space, other blank, anything else, and those of the contractions.
LETTER, NUMBER, SPACE, BLANK, OTHER, QUOTE, STOP = range(7)
_S_, _T_, _R_, _V_, _M_, _L_, _D_, _E_ = range(7, 15)
CLASSES = 15
# States of the splitter: what the word being read is.
(START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_SPACE, BLANKS, BLANKS_SPACE, QUOTED, QUOTED_R, QUOTED_L) = range(10)
STATES = 10
# What a transition emits: no mark, a mark at this character, or a mark at the one before it.
NONE, HERE, BEFORE = 0, 1, 2


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emission) by state and class, of the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?letters+| ?numbers+| ?others+|blanks+(?!non-blank)|blanks+

    A run of blanks before a non-blank gives its last blank to the next word if that is a space, and else is a word of
    its own without its last blank, which is one too: so the mark is placed one back. A contraction is met only where
    a word begins with the quote; if what follows isn't one, the quote is a run of others.
    """
    nxt, out = np.zeros((STATES, CLASSES), np.int64), np.zeros((STATES, CLASSES), np.int64)
    letters = [LETTER, *range(_S_, CLASSES)]
    begins = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, SPACE: ONE_SPACE, BLANK: BLANKS, OTHER: IN_OTHERS, QUOTE: QUOTED, STOP: START} | dict.fromkeys(letters, IN_LETTERS)
    for c in range(CLASSES):
        nxt[:, c], out[:, c] = begins[c], HERE  # unless said otherwise, a word begins here
    for c in letters:
        nxt[IN_LETTERS, c], out[IN_LETTERS, c] = IN_LETTERS, NONE
        nxt[ONE_SPACE, c], out[ONE_SPACE, c] = IN_LETTERS, NONE
    nxt[IN_NUMBERS, NUMBER], out[IN_NUMBERS, NUMBER] = IN_NUMBERS, NONE
    nxt[ONE_SPACE, NUMBER], out[ONE_SPACE, NUMBER] = IN_NUMBERS, NONE
    for c in (OTHER, QUOTE):
        for s in (IN_OTHERS, ONE_SPACE, QUOTED):
            nxt[s, c], out[s, c] = IN_OTHERS, NONE
    for s in (ONE_SPACE, BLANKS, BLANKS_SPACE):  # a run of blanks grows
        nxt[s, SPACE], out[s, SPACE] = BLANKS_SPACE, NONE
        nxt[s, BLANK], out[s, BLANK] = BLANKS, NONE
    for c in (*letters, NUMBER, OTHER, QUOTE):
        to = {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, QUOTE: IN_OTHERS}.get(c, IN_LETTERS)
        nxt[BLANKS_SPACE, c], out[BLANKS_SPACE, c] = to, BEFORE  # the last space goes with the word
        # after another blank the word begins here, and so did the last blank: the caller marks both
    # contractions: the quote and the letters after it; a word that follows begins at its first letter
    for c in (_S_, _T_, _M_, _D_):
        nxt[QUOTED, c], out[QUOTED, c] = START, NONE
    for c in (_V_, _R_):
        nxt[QUOTED, c], out[QUOTED, c] = QUOTED_R, HERE
    nxt[QUOTED, _L_], out[QUOTED, _L_] = QUOTED_L, HERE
    # after 'v, 'r or 'l: the second letter completes a contraction and takes the mark at the first back
    for c in letters:
        for s in (QUOTED_R, QUOTED_L):
            nxt[s, c], out[s, c] = IN_LETTERS, NONE
    nxt[QUOTED_R, _E_], out[QUOTED_R, _E_] = START, UNDO
    nxt[QUOTED_L, _L_], out[QUOTED_L, _L_] = START, UNDO
    return nxt, out


UNDO = 3
NEXT, EMIT = _splitter()


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point; the general categories are those of the regular-expression library."""
    import regex

    every = "".join(map(chr, range(0xD800))) + "\x00" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    of = np.full(0x110000, OTHER, np.uint8)
    for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
        for m in regex.finditer(pattern, every):
            of[m.start() : m.end()] = c
    of[0x20], of[0x27] = SPACE, QUOTE
    for char, c in zip("strvmlde", (_S_, _T_, _R_, _V_, _M_, _L_, _D_, _E_), strict=True):
        of[ord(char)] = c
    return of


def word_starts(classes: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Whether a word begins at each character of a block; `stops` marks where a text begins."""
    n = len(classes)
    width = min(CHUNK, max(1, n))
    chunks = -(-n // width)
    padded = np.full(chunks * width, STOP, np.uint8)
    padded[:n] = classes
    fresh = np.zeros(chunks * width, bool)
    fresh[:n] = stops
    steps, fresh = padded.reshape(chunks, width).T.copy(), fresh.reshape(chunks, width).T.copy()
    # 1. every chunk's state map, all chunks and all states in lock step
    maps = np.tile(np.arange(STATES), (chunks, 1))
    for k in range(width):
        maps = NEXT[np.where(fresh[k][:, None], START, maps), steps[k][:, None]]
    # 2. inclusive prefix scan of the maps under composition, in log2(chunks) rounds
    scan, reach = maps, 1
    while reach < chunks:
        later = np.take_along_axis(scan[reach:], scan[:-reach], axis=1)
        scan = np.concatenate([scan[:reach], later])
        reach *= 2
    # 3. with its first state known, each chunk is read once more for what it emits
    state = np.concatenate([[START], scan[:-1, START]])
    marks = np.zeros((width, chunks), np.uint8)
    blank = np.zeros((width, chunks), bool)
    for k in range(width):
        state = np.where(fresh[k], START, state)
        marks[k] = EMIT[state, steps[k]]
        blank[k] = state == BLANKS
        state = NEXT[state, steps[k]]
    marks, blank = marks.T.ravel()[:n], blank.T.ravel()[:n]
    starts = marks == HERE
    starts[np.flatnonzero(marks == BEFORE) - 1] = True
    starts[np.flatnonzero(marks == UNDO) - 1] = False
    # a run of blanks that ends in another blank than a space: that blank is a word of its own
    starts[np.flatnonzero(blank & (marks == HERE)) - 1] = True
    return starts | stops


class Merger:
    """Byte-pair merging as a deterministic transducer over the bytes of one word, compiled as states are met."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in merges}
        self.prefixes = {t[:i] for t in self.tokens for i in range(1, len(t) + 1)}
        self.made = {a + b: (a, b) for a, b in reversed(merges)}
        self.wholes: dict[bytes, bool] = {}
        self.spines: dict[tuple[bytes, int], list[tuple[bytes, int]]] = {}
        self.by_start: dict[bytes, list[bytes]] = {}
        for t in self.tokens:
            for i in range(2, len(t)):
                self.by_start.setdefault(t[:i], []).append(t)
        self.clear()

    def clear(self) -> None:
        """Forget the compiled states; they are made again when met."""
        self.classes: dict[tuple[bytes, bytes], bytes] = {}
        self.alike: dict[tuple, bytes] = {}
        self.states: dict[tuple, int] = {}
        self.what: list[tuple] = []
        self.next = np.full((1024, 256), -1, np.int32)
        self.emit = np.zeros((1024, 256), np.int16)
        self.state(b"", ((b"", 0),))

    def merged(self, word: bytes) -> list[bytes]:
        """The merge loop itself, on the few bytes of one token."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            ranks = [self.rank.get((parts[i], parts[i + 1])) for i in range(len(parts) - 1)]
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                break
            out, i = [], 0
            while i < len(parts):
                if i < len(ranks) and ranks[i] == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def spine(self, t: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts that stand at the end (side 1) or the beginning (side 0) of t while it's being merged, each with the
        rank of the merge that ends it."""
        got = self.spines.get((t, side))
        if got is None:
            got, ends = [], len(self.rank)
            while True:
                got.append((t, ends))
                if t not in self.made:
                    break
                ends = self.rank[self.made[t]]
                t = self.made[t][side]
            self.spines[got[0][0], side] = got
        return got

    def stays(self, a: bytes, b: bytes) -> bool:
        """Whether tokens a and b, side by side, are what merging makes of their bytes.

        They aren't if some merge across the junction comes up while both of its parts stand. Of merges of one rank the
        leftmost is done first, hence the tie.
        """
        rank = self.rank.get
        ends = self.spine(b, 0)
        return not any((r := rank((x, y))) is not None and r < x_ends and r <= y_ends for x, x_ends in self.spine(a, 1) for y, y_ends in ends)

    def whole(self, t: bytes) -> bool:
        """Whether merging makes the single token t of its bytes (a merge list may hold tokens that it never makes)."""
        got = self.wholes.get(t)
        if got is None:
            got = self.wholes[t] = self.merged(t) == [t]
        return got

    def kind(self, last: bytes, begun: bytes) -> bytes:
        """A token that stands for all those that allow the same next tokens, of those that begin with `begun`, after
        them as `last` does. Of a single byte too many tokens begin: there each stands for itself."""
        if len(begun) < 2:
            return last
        got = self.classes.get((last, begun))
        if got is None:
            barred = tuple(t for t in self.by_start.get(begun, ()) if last and not self.stays(last, t))
            got = self.classes[last, begun] = self.alike.setdefault((begun, barred), last)
        return got

    def state(self, tail: bytes, last: tuple) -> int:
        """The state after a prefix: `tail`, its longest end that begins a token, and for each cut of the tail at which
        a token may begin the last token before the cut and the number of tokens up to it, less that up to the end."""
        key = (tail, last)
        got = self.states.get(key)
        if got is None:
            got = self.states[key] = len(self.what)
            self.what.append(key)
            if got >= len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.emit = np.concatenate([self.emit, np.zeros_like(self.emit)])
        return got

    def compile(self, s: int, byte: int) -> None:
        """The transition of state s on a byte."""
        tail, last = self.what[s]
        grown = tail + bytes([byte])
        found = None
        for cut in range(len(grown)):  # the last token begins at one cut
            t = grown[cut:]
            if last[cut] and t in self.tokens and self.whole(t) and (not last[cut][0] or self.stays(last[cut][0], t)):
                found = (t, last[cut][1] + 1)
                break
        t, count = found
        keep = 0
        while keep < len(grown) and grown[keep:] not in self.prefixes:
            keep += 1
        # a cut at which no token can begin any more is forgotten, so that more prefixes share a state
        cuts = [(*x,) if i == len(grown) or x and grown[i:] in self.prefixes else None for i, x in enumerate((*last, (t, count))) if i >= keep]
        to = self.state(grown[keep:], tuple(x and (self.kind(x[0], grown[keep + i :]), x[1] - count) for i, x in enumerate(cuts)))
        self.next[s, byte], self.emit[s, byte] = to, count

    def count(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tokens that each byte adds; words begin at `starts`. Runs of words of about CHUNK bytes go in lock step."""
        if len(self.what) > MOST_STATES:
            self.clear()
        n = len(data)
        begin = np.flatnonzero(starts)
        # a chunk begins at the first word at or after each multiple of CHUNK: states there are the first state
        cuts = np.unique(begin[np.minimum(np.searchsorted(begin, np.arange(0, n, CHUNK)), len(begin) - 1)])
        size = np.diff(np.append(cuts, n))
        order = np.argsort(-size, kind="stable")
        cuts, size = cuts[order], size[order]
        added = np.zeros(n, np.int32)
        state = np.zeros(len(cuts), np.int64)
        for k in range(int(size[0])):
            live = int(np.searchsorted(-size, -k, side="left"))
            at = cuts[:live] + k
            s = np.where(starts[at], 0, state[:live])
            b = data[at]
            to = self.next[s, b]
            if (to < 0).any():
                for x, y in set(zip(s[to < 0].tolist(), b[to < 0].tolist(), strict=True)):
                    self.compile(x, y)
                to = self.next[s, b]
            added[at] = self.emit[s, b]
            state[:live] = to
        return added


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of bytes in the vocabulary file: printable Latin-1 characters stand for themselves, the
    other bytes for the characters from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def load(path: str) -> tuple[Merger, tuple[str, ...]]:
    """(merger, special strings) of a byte-level vocabulary file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    chars = _byte_chars()
    pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
    merges = [tuple(bytes(chars[c] for c in x) for x in p) for p in pairs]
    return Merger(merges), tuple(x["content"] for x in spec["added_tokens"])


def count_tokens(texts: list[bytes | None], merger: Merger, specials: tuple[str, ...]) -> np.ndarray:
    """Tokens of each text. A special string inside a text is one token, and the parts around it are texts of their own."""
    import regex

    total = np.zeros(len(texts), np.int64)
    cut = regex.compile(b"|".join(regex.escape(s.encode()) for s in sorted(specials, key=len, reverse=True))) if specials else None
    parts, owner = [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        pieces = [text]
        if cut and any(s.encode() in text for s in specials):
            pieces = cut.split(text)
            total[i] += len(pieces) - 1
        for p in pieces:
            if p:
                parts.append(p)
                owner.append(i)
    at = 0
    while at < len(parts):
        to, size = at, 0
        while to < len(parts) and (to == at or size + len(parts[to]) <= BLOCK):
            size += len(parts[to])
            to += 1
        data = np.frombuffer(b"".join(parts[at:to]), np.uint8)
        firsts = np.cumsum([0, *[len(p) for p in parts[at : to - 1]]])
        lead = (data & 0xC0) != 0x80  # bytes that begin a character
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        place = np.flatnonzero(lead)
        stops = np.zeros(len(data), bool)
        stops[firsts] = True
        starts = np.zeros(len(data), bool)
        starts[place] = word_starts(_classes()[points], stops[place])
        np.add.at(total, owner[at:to], np.add.reduceat(merger.count(data, starts), firsts))
        at = to
    return total


def token_counts(docs: DataFrame, *, text: str = "text", path: str, out: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens that the vocabulary file at `path` gives each text.

    The count is that of the vocabulary's own library, without tokens added at the ends. Null and empty texts have 0. A
    column of docs named `out` is replaced; all others are kept. An empty table gives an empty result. The file is
    read on each executor, where it must be installed; its automaton is compiled once per worker process.
    """
    from pyspark.sql import types as T

    docs = docs.drop(out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())])

    def count(batches):
        merger, specials = load(path)
        for whole in batches:
            for batch in slices(whole, text=text):
                n = count_tokens(binary(batch.column(text)), merger, specials)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n)], names=schema.names)

    return docs.mapInArrow(count, schema)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents by the byte-level vocabulary of 50,257 tokens."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = token_counts(docs, path=public_tokenizers.path("byte_bpe_50k.json"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return got.select("doc_id", n_bytes, "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
