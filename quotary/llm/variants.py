"""Spelling variants: words one edit apart, by a trie over letter-group counts.

A word's vector counts its letters by group; the trie takes the counts one after another. One inserted letter adds one to a
count, one deleted takes one away, one replaced may do both: a search that walks the trie with a surplus of one and a
deficit of one to spend reaches all words within one edit, and the words at its leaves are verified. Of each pair one word
searches and the other is found: the one whose vector has the surplus first.

The top of the trie is walked by Spark, a few levels at a time, for branches of too many rows; a branch that is small
enough is one group, in which a task builds the rest of the trie and searches it depth first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotary.llm.common import materialize, table
from quotary.llm.importance import crc_sql

#: Letters of words, as a regular expression's set, and the code points in it.
LETTERS = r"A-Za-zÀ-ÿ"
_POINTS = [*range(97, 123), *range(65, 91), *range(0xC0, 0x100)]
#: Words have so many code points and occurrences at least; a form has so many times the occurrences of its variant.
LEAST_LETTERS, LEAST_COUNT, TIMES = 7, 2, 10
#: One run in so many, by its checksum, loses a code point.
DAMAGED = 31
#: Letter groups: levels of the trie. Levels that Spark walks first, and each time a branch has more than ROWS rows.
GROUPS, FIRST, NEXT, ROWS = 24, 4, 2, 60_000
#: Words under a trie node from which they are compared without going deeper, and comparisons made at a time.
LEAF, AT_ONCE = 24, 1 << 21
#: What a row is in a branch: a word to be found, or one that searches, by what it has spent: nothing, the surplus, both.
MEMBER, FRESH, SURPLUS, SPENT = -1, 0, 1, 2
#: Code points that the vectorised comparison holds; longer words are compared one at a time.
WIDE = 48


def damaged_words(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = LEAST_LETTERS) -> DataFrame:
    """(word, n): the runs of letters of whole texts, A-Z lower-cased, and how often each comes up; where the checksum of
    key, colon and run is divisible by DAMAGED, without the code point at checksum % length. Results of under `least`
    code points are left out."""
    low = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # a run that is too short stays so: matching takes whole runs of `least` letters or more
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("run"))
    hashed = runs.select(low.alias("run"), F.crc32(F.encode(F.concat("k", F.lit(":"), low), "UTF-8")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _encoded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words, number of each word's)."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.array([len(w) for w in words], np.int64)


def letter_counts(vocabulary: DataFrame) -> np.ndarray:
    """Occurrences in distinct words of each code point below 256: a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            points, _ = _encoded(batch.column(0).to_pylist())
            total += np.bincount(np.minimum(points, 255), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256), pa.int32()), pa.array(total)], ["point", "n"])

    out = np.zeros(256, np.int64)
    for r in vocabulary.select("word").mapInArrow(count, "point int, n long").groupBy("point").agg(F.sum("n").alias("n")).collect():
        out[r["point"]] = r["n"]
    return out


def grouping(counts: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Group of each code point below 256: the most frequent letters have groups of their own, which come first, as they
    tell words apart best; the others go to the group that is least full."""
    out, full = np.zeros(256, np.uint8), np.zeros(groups, np.int64)
    for point in sorted(range(256), key=lambda p: (-int(counts[p]), p)):
        least = int(np.argmin(full))
        out[point] = least
        full[least] += int(counts[point]) + 1
    order = np.argsort(np.argsort(-full, kind="stable"), kind="stable")
    return order[out].astype(np.uint8)


def vectors(words: list[str], group: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Letter-group counts of each word, at most 255: a capped count differs by no more than the count itself."""
    points, length = _encoded(words)
    owner = np.repeat(np.arange(len(words)), length)
    flat = np.bincount(owner * groups + group[np.minimum(points, 255)], minlength=len(words) * groups)
    return np.minimum(flat, 255).astype(np.uint8).reshape(len(words), groups)


def step(counts: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, count, state) of the children that rows with these counts at a level go to: members and all states to their own
    count; one that has spent nothing to one more, too; one that has only spent the surplus to one less."""
    rows = np.arange(len(counts))
    more, less = rows[(state == FRESH) & (counts < 255)], rows[(state == SURPLUS) & (counts > 0)]
    at = np.concatenate([rows, more, less])
    child = np.concatenate([counts, counts[more] + 1, counts[less] - 1]).astype(np.uint8)
    return at, child, np.concatenate([state, np.full(len(more), SURPLUS, np.int8), np.full(len(less), SPENT, np.int8)])


def descend(rows: DataFrame, group: np.ndarray, depth: int, levels: int, groups: int = GROUPS) -> DataFrame:
    """(node, state, word, n) `levels` levels further down the trie; node is the path of counts."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                words = batch.column("word").to_pylist()
                vec = vectors(words, group, groups)
                at, state = np.arange(len(words)), batch.column("state").to_numpy().astype(np.int8)
                path = np.frombuffer(b"".join(batch.column("node").to_pylist()), np.uint8).reshape(len(words), depth)
                for level in range(depth, depth + levels):
                    row, child, state = step(vec[at, level], state)
                    path, at = np.hstack([path[row], child[:, None]]), at[row]
                width = depth + levels
                node = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.arange(0, width * len(at) + 1, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(path))])
                taken = batch.select(["word", "n"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([node, pa.array(state), *taken.columns], ["node", "state", "word", "n"])

    return rows.mapInArrow(walk, "node binary, state byte, word string, n long")


def one_edit(a: str, b: str) -> bool:
    """Whether the words differ by exactly one inserted, deleted or replaced code point."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:  # the length of what they begin with in common
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return a[lo + (len(a) >= len(b)) :] == b[lo + (len(b) >= len(a)) :]


class Search:
    """The rest of the trie below one branch, searched depth first by all words that come to it."""

    def __init__(self, words: list[str], vec: np.ndarray, state: np.ndarray):
        self.words, self.vec, self.state = words, vec, state
        points, self.length = _encoded(words)
        self.grid = np.zeros((len(words), WIDE), np.uint8)  # a code point's place among LETTERS, from 1
        code = np.zeros(256, np.uint8)
        code[_POINTS] = np.arange(1, len(_POINTS) + 1)
        start = np.cumsum(self.length) - self.length
        place = np.arange(len(points)) - np.repeat(start, self.length)
        keep = place < WIDE
        self.grid[np.repeat(np.arange(len(words)), self.length)[keep], place[keep]] = code[np.minimum(points[keep], 255)]
        #: Words in code-point order: of two with one vector the smaller one searches.
        self.order = np.argsort(np.argsort(np.array(words, dtype=object), kind="stable"), kind="stable")
        self.left, self.right, self.held, self.found = [], [], 0, []

    def run(self, depth: int) -> np.ndarray:
        """(searching row, found row) pairs of words one edit apart."""
        members = np.flatnonzero(self.state == MEMBER)
        rows = np.flatnonzero(self.state != MEMBER)
        members = members[np.lexsort(self.vec[members].T[::-1])]
        if len(members) and len(rows):
            self.visit(depth, members, rows, self.state[rows])
        self.verify()
        return np.concatenate(self.found) if self.found else np.zeros((0, 2), np.int64)

    def visit(self, level: int, members: np.ndarray, rows: np.ndarray, state: np.ndarray) -> None:
        """Spend what is left of the budgets of `rows` on the counts of this level, a child after another."""
        if len(members) <= LEAF or level == self.vec.shape[1]:
            self.compare(level, members, rows, state)
            return
        at, child, states = step(self.vec[rows, level], state)
        counts = self.vec[members, level]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(counts)) + 1, [len(members)]])
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            here = np.flatnonzero(child == counts[lo])
            if len(here):
                self.visit(level + 1, members[lo:hi], rows[at[here]], states[here])

    def compare(self, level: int, members: np.ndarray, rows: np.ndarray, state: np.ndarray) -> None:
        """Pairs whose remaining counts keep to the budgets, to be verified."""
        rest = self.vec.shape[1] - level
        m = self.vec[members, level:].astype(np.int16)
        most = max(1, AT_ONCE // max(1, len(members) * max(rest, 1)))
        for lo in range(0, len(rows), most):
            some, s = rows[lo : lo + most], state[lo : lo + most, None]
            diff = m[None] - self.vec[some, None, level:].astype(np.int16)
            more, less, size = (diff == 1).sum(2), (diff == -1).sum(2), np.abs(diff).sum(2)
            plain = size == 0
            ok = (more + less == size) & (more <= (s == FRESH)) & (less <= (s != SPENT))
            if rest:
                first = np.take_along_axis(diff, np.argmax(diff != 0, axis=2)[..., None], 2)[..., 0]
                ok &= (s != FRESH) | (first >= 0)
            ok &= ~plain | (s != FRESH) | (self.order[some][:, None] < self.order[members][None])
            a, b = np.nonzero(ok)
            self.left.append(some[a]), self.right.append(members[b])
            self.held += len(a)
            if self.held > 100_000:
                self.verify()

    def verify(self) -> None:
        """Keep of the pairs held those that are one edit apart."""
        if not self.held:
            return
        a, b = np.concatenate(self.left), np.concatenate(self.right)
        self.left, self.right, self.held = [], [], 0
        swap = self.length[a] > self.length[b]
        short, long = np.where(swap, b, a), np.where(swap, a, b)
        gap = self.length[long] - self.length[short]
        wide = self.length[long] > WIDE
        x, y = self.grid[short], self.grid[long]
        differ = x != y
        replaced = (gap == 0) & (differ.sum(1) == 1)
        # inserted: what is equal from the front and what is equal from the back cover the shorter word
        front = np.argmax(differ, axis=1)
        shifted = np.hstack([x[:, :-1] != y[:, 1:], np.zeros((len(x), 1), bool)])
        shifted &= np.arange(WIDE)[None] < self.length[short][:, None]
        last = np.where(shifted.any(1), WIDE - np.argmax(shifted[:, ::-1], axis=1), 0)
        near = replaced | ((gap == 1) & differ.any(1) & (last <= front))
        for i in np.flatnonzero(wide):
            near[i] = one_edit(self.words[a[i]], self.words[b[i]])
        self.found.append(np.stack([a[near], b[near]], axis=1))


def near_in_branch(group: np.ndarray, depth: int, groups: int = GROUPS):
    """The task's part: for each word of a branch the number of near words found here, and the best of them."""

    def search(t: pa.Table) -> pa.Table:
        words, n = t.column("word").to_pylist(), t.column("n").to_numpy()
        s = Search(words, vectors(words, group, groups), t.column("state").to_numpy().astype(np.int8))
        pairs = s.run(depth)
        one, other = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        order = np.lexsort((s.order[other], -n[other], one))
        one, other = one[order], other[order]
        first = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]])) if len(one) else np.zeros(0, np.int64)
        count = np.diff(np.concatenate([first, [len(one)]]))
        pick = lambda rows: pa.array([words[i] for i in rows], pa.string())
        return pa.table({"word": pick(one[first]), "n_near": pa.array(count, pa.int64()), "form": pick(other[first]), "form_n": pa.array(n[other[first]], pa.int64())})

    return search


NEAR = "word string, n_near long, form string, form_n long"


def near_words(vocabulary: DataFrame, groups: int = GROUPS) -> DataFrame:
    """(word, n_near, form, form_n): for each word of (word, n) that has words one edit apart their number, and the one of
    largest n, ties to the smaller word."""
    group = grouping(letter_counts(vocabulary), groups)
    start = vocabulary.select(F.lit(b"").alias("node"), F.explode(F.array(F.lit(MEMBER).cast("byte"), F.lit(FRESH).cast("byte"))).alias("state"), "word", "n")
    rows, depth, parts = start, 0, []
    while True:
        levels = min(NEXT if depth else FIRST, groups - depth)
        depth += levels
        rows = materialize(descend(rows, group, depth - levels, levels, groups), "branches")
        nodes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("all"), F.sum((F.col("state") == MEMBER).cast("long")).alias("members"))
        nodes = materialize(nodes.where("members > 0").select("node", "all", "members"), "nodes")
        small, large = nodes.where(F.col("all") <= ROWS).select("node"), nodes.where(F.col("all") > ROWS)
        parts.append(rows.join(small, "node").groupBy("node").applyInArrow(near_in_branch(group, depth, groups), NEAR))
        if large.isEmpty():
            break
        if depth == groups:  # one leaf of very many words or searches: both are dealt into tiles
            parts.append(_tiles(rows, large, depth).groupBy("node", "_m", "_s").applyInArrow(near_in_branch(group, depth, groups), NEAR))
            break
        rows = rows.join(large.select("node"), "node")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    best = F.min(F.struct((-F.col("form_n")).alias("by"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_b")).select("word", "n_near", F.col("_b.form").alias("form"), (-F.col("_b.by")).alias("form_n"))


def _tiles(rows: DataFrame, large: DataFrame, depth: int) -> DataFrame:
    """Rows of leaves of over ROWS rows, so dealt that each search meets each member in one tile of some ROWS rows."""
    half = ROWS // 2
    sized = rows.join(large, "node").withColumns({"_ms": F.ceil(F.col("members") / half).cast("int"), "_ss": F.ceil((F.col("all") - F.col("members")) / half).cast("int")})
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n: F.array(F.pmod(F.xxhash64("word"), F.col(n)).cast("int"))
    member = F.col("state") == MEMBER
    dealt = sized.withColumn("_m", F.explode(F.when(member, own("_ms")).otherwise(every("_ms"))))
    return dealt.withColumn("_s", F.explode(F.when(member, every("_ss")).otherwise(own("_ss")))).select("node", "_m", "_s", "state", "word", "n")


def variants(vocabulary: DataFrame, *, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of (word, n), words being distinct and made of LETTERS.

    form is the near word of largest n, if that is `times` the word's n or more, else null with a null form_n; n_near counts
    near words whatever their n. root follows forms to the last one, and is the word itself where it has none: n grows at
    every step, so the walk ends after log(n) / log(times) steps. Words may have any length and hold any letters once or
    often. An empty vocabulary gives an empty result.
    """
    vocabulary = materialize(vocabulary, "vocabulary")
    near = near_words(vocabulary)
    is_form = F.col("form_n") >= F.col("n") * times
    told = vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"))
    told = materialize(told, "forms")
    links = told.where("form is not null").select(F.col("word").alias("_from"), F.col("form").alias("_to"))
    roots = links.select(F.col("_from").alias("word"), F.col("_to").alias("root"))
    while True:
        further = roots.join(links, F.col("root") == F.col("_from"), "left")
        moved = materialize(further.select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("_moved")), "roots")
        roots = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            break
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """variants() of the words of whole texts that come up `least_count` times or more.

    Null and empty texts have no words; a null key is an empty string in the checksum. Repeated rows count each. A run of any length is
    one word. Other columns aren't read. An empty table gives an empty result.
    """
    return variants(damaged_words(docs, key=key, text=text, least=least).where(F.col("n") >= least_count), times=times)


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with the forms that they vary."""
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP12_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{{LEAST_LETTERS},}}')) AS run FROM documents) GROUP BY 1, 2
), hashed AS (SELECT run, n, {crc_sql("doc_id || ':' || run")} AS h FROM runs),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % {DAMAGED} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}
), holes AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS hole FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM holes a JOIN holes b ON a.hole = b.hole AND a.i = b.i AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.hole = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.hole = b.word
), best AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, other)) AS other FROM near GROUP BY word),
told AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {TIMES} * n THEN other END AS form, CASE WHEN m >= {TIMES} * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root FROM told UNION ALL SELECT walk.word, told.form FROM walk JOIN told ON walk.root = told.word WHERE told.form IS NOT NULL)
SELECT told.word, form, last.root, told.n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM told
JOIN (SELECT walk.word, arg_max(root, r.n) AS root FROM walk JOIN words r ON r.word = walk.root GROUP BY walk.word) last ON last.word = told.word
"""
