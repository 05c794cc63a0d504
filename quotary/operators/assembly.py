"""Putting a document together: references in place, labels over ranges, chunks and cards as blocks, and what audits them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotary.functions.text import half_up, let, words
from quotary.operators.grams import gram_hashes
from quotary.operators.quotes import Hearing
from quotary.sources.scratch import materialize

#: Words into a text up to which a label's passage may begin; words of a partly recited passage; share of a gap that is a card's.
FROM, PARTLY, SHARE = 6, 4, 0.6


def resolve_located(located: DataFrame, doc: str) -> DataFrame:
    """(doc, ref, start, end): W5. located(doc, ref, card, group, passage, start, end, n_chars) in order of their places.

    Of two that overlap, two cards of different passages both stay and the earlier ends where the later begins; of others
    the longer text stays. A fold over a document's own references."""
    one = F.struct("start", "ref", "end", "card", "group", "passage", "n_chars")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        both = last["card"] & x["card"] & ((last["group"] != x["group"]) | (last["passage"] != x["passage"])) & (x["start"] > last["start"])
        cut = F.struct(last["start"].alias("start"), last["ref"].alias("ref"), x["start"].alias("end"), *[last[c].alias(c) for c in ("card", "group", "passage", "n_chars")])
        front = F.slice(acc, 1, F.size(acc) - 1)
        return F.when((F.size(acc) == 0) | (x["start"] >= last["end"]), F.concat(acc, F.array(x))).when(both, F.concat(front, F.array(cut, x))).when(x["n_chars"] > last["n_chars"], F.concat(front, F.array(x))).otherwise(acc)

    listed = located.groupBy(doc).agg(F.array_sort(F.collect_list(one)).alias("_c"))
    kept = F.aggregate("_c", F.filter("_c", lambda x: F.lit(False)), step)
    return listed.select(doc, F.explode(kept).alias("k")).select(doc, "k.ref", "k.start", "k.end")


#: Passages of a group that are labelled by one task at a time, a power of 2, those to either side that it holds too, and texts that it labels.
SHELF, MARGIN, TEXTS = 1024, 32, 20_000
#: Steps back after which those of equal texts are looked up, and how many are kept.
STEPS, KEPT = 4, 50_000


def range_labels(refs: DataFrame, canon: DataFrame, key: str) -> DataFrame:
    """(key, first, last, n_words): X10. refs(key, group, passage, words) labelled with all passages that their words go over,
    and how many of the words are the label's. canon(group, passage, words).

    The label steps back while the passage before begins the text, FROM words in at most, and the label's follows; goes on
    while the next passage follows; takes in a last passage of which PARTLY words or more are left; else words left over,
    three or more, are cut off. A label whose passage, or a tail of it of three words, isn't near the text's start stays.

    Passages and texts meet once, on the shelf of a group that has the text's passage; a shelf with many texts is dealt out
    as often as they need. A text that leaves the shelf's margin goes on from there in another round."""
    shelf = lambda c: F.shiftright(c.cast("long"), SHELF.bit_length() - 1)
    kinds = {c: refs.schema[c].dataType.simpleString() for c in (key, "group", "passage")}
    p = F.col("passage")
    beside = F.array_distinct(F.array(shelf(p), shelf(p - MARGIN), shelf(p + MARGIN)))
    known = canon.where("group is not null and passage is not null").select(F.col("group").cast(kinds["group"]).alias("group"), F.col("passage").cast("long").alias("at"), _as_text(F.col("words")).alias("_w"), F.explode(beside).alias("_b"))
    live = refs.where("group is not null and passage is not null").select(F.col(key).alias("_key"), "group", p.cast("long").alias("at"), "words", F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("pos"))
    live = live.where("size(words) > 0").withColumn("words", _as_text(F.col("words")))
    state, done, held = [F.col(c) for c in ("_key", "at", "first", "pos")], None, known
    while True:
        texts = live.withColumn("_b", shelf(F.col("at")))
        met = held.select("group", "_b", F.lit(0).alias("_part"), "at", F.lit(None).cast(kinds[key]).alias("_key"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("pos"), "_w")
        parts = F.lit(0)
        full = texts.groupBy("group", "_b").agg(F.ceil(F.count(F.lit(1)) / TEXTS).cast("int").alias("_n")).where("_n > 1").collect()  # one row for TEXTS texts at most
        if full:
            hot = F.broadcast(live.sparkSession.createDataFrame(full, f"group {kinds['group']}, _b long, _n int"))
            texts, met = (x.join(hot, ["group", "_b"], "left").withColumn("_n", F.coalesce("_n", F.lit(1))) for x in (texts, met))
            parts = F.pmod(F.xxhash64("_key", "words"), F.col("_n")).cast("int")
            met = met.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
        met = met.select("group", "_b", "_part", F.lit(False).alias("_text"), *state, F.col("_w").alias("words")).unionByName(texts.select("group", "_b", parts.alias("_part"), F.lit(True).alias("_text"), *state, "words"))
        dealt = met.repartition("group", "_b", "_part").sortWithinPartitions("group", "_b", "_part", "_text", "at")
        got = dealt.mapInArrow(_labelled, f"_key {kinds[key]}, group {kinds['group']}, at long, first long, pos long, words string, last long, n_words long")
        got = materialize(got, "labels")
        ended = got.where("words is null").select(F.col("_key").alias(key), F.col("first").cast(kinds["passage"]).alias("first"), F.col("last").cast(kinds["passage"]).alias("last"), "n_words")
        done = ended if done is None else done.unionByName(ended)
        live = got.where("words is not null").select("_key", "group", "at", "words", "first", "pos")
        if live.isEmpty():
            return done
        live = materialize(live, "left")  # Spark knows how small it is then
        shelves = live.select("group", shelf(F.col("at")).alias("_b")).distinct()  # by group first, as that goes down to where the canon is read
        held = known.join(shelves.select("group").distinct(), "group", "left_semi").join(shelves, ["group", "_b"], "left_semi")


#: Stands before each word of a list that is carried as one text.
WORD = "\x1f"


def _as_text(said: Column) -> Column:
    """A list of words as one text, as it takes half the room of an array; JSON where a word is null or has WORD in it."""
    return F.when(F.exists(said, lambda w: w.isNull() | F.contains(w, F.lit(WORD))), F.to_json(said)).otherwise(F.concat(F.when(F.size(said) > 0, WORD).otherwise(""), F.array_join(said, WORD)))


def _as_words(text: str | None) -> list:
    return json.loads(text) if text and text[0] != WORD else text[1:].split(WORD) if text else []


class _Shelf:
    """Passages SHELF * b to SHELF * (b + 1) of a group with MARGIN to either side, and how a text goes over them."""

    def __init__(self, b: int, hearing: Hearing):
        self.low, self.high, self.stands, self.passages, self.back = b * SHELF - MARGIN, (b + 1) * SHELF + MARGIN, hearing.stands, {}, {}

    def words(self, at: int) -> list | None:
        w = self.passages.get(at)
        if isinstance(w, str):
            w = self.passages[at] = _as_words(w)
        return w

    def place(self, w: list, said: list) -> int:
        """Where a passage stands near the text's start, -1 if nowhere; one of two words must be there as it is."""
        n = len(w)
        for s in range(min(len(said) - 1, FROM) + 1):
            if self.stands(w, 0, n, said, s) if n >= 3 else said[s : s + n] == w:
                return s
        return -1

    def leads(self, at: int, before: list, said: list) -> bool:
        """Whether the passage before begins the text and passage `at`, or of its beginning all that is left of the text, follows."""
        s = self.place(before, said)
        own, pos = self.words(at), s + len(before)
        left = len(said) - pos
        return s >= 0 and (self.stands(own, 0, len(own), said, pos) or (left >= PARTLY and len(own) > left and self.stands(own, 0, left, said, pos)))

    def step_back(self, at: int, said: list) -> tuple[int, bool]:
        """How far back the label goes, and whether that is known: not so beyond the shelf."""
        start, text = at, None
        while at > self.low:
            if start - at >= STEPS:
                text = text or tuple(said)
                if (text, at) in self.back:
                    at = self.back[text, at]
                    break
            before = self.words(at - 1)
            if not before or not self.leads(at, before, said):
                break
            at -= 1
        if text:
            if len(self.back) + start - at > KEPT:
                self.back.clear()
            self.back.update({(text, x): at for x in range(start, max(at, start - KEPT) - 1, -1)})
        return at, at > self.low

    def begin(self, at: int, said: list) -> int:
        """The place after passage `at`, or after the longest tail of it, near the text's start; -1 if there is none."""
        own = self.words(at)
        n = len(own)
        for cut in range(max(n - 3, 0) + 1):
            for s in range(min(len(said) - 1, FROM) + 1):
                if self.stands(own, cut, n, said, s):
                    return s + n - cut
        return -1

    def label(self, at: int, first: int | None, pos: int | None, said: list) -> tuple:
        """(at, first, pos, last, n_words); without the last two where it must be gone on from `at` on another shelf."""
        if first is None:
            at, known = self.step_back(at, said)
            if not known:
                return at, None, None, None, None
            first, pos = at, self.begin(at, said)
            if pos < 0:
                return at, first, pos, first, len(said)
        while at + 1 < self.high:
            after = self.words(at + 1)
            if not after or not self.stands(after, 0, len(after), said, pos):
                left = len(said) - pos
                if after and left >= PARTLY and len(after) > left and self.stands(after, 0, left, said, pos):
                    return at, first, pos, at + 1, len(said)
                return at, first, pos, at, pos if left >= 3 else len(said)
            at, pos = at + 1, pos + len(after)
        return at, first, pos, None, None


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by shelf, its passages before its texts: the texts' labels, or with their words how far they came."""
    hearing, here, shelf = Hearing(), None, None
    for batch in batches:
        rows = {c: batch.column(c).to_pylist() for c in ("group", "_b", "_part", "_text", "at", "first", "pos", "words")}
        taken, got = [], []
        for i, (group, b, part, text, at, first, pos, w) in enumerate(zip(*rows.values(), strict=True)):
            if here != (group, b, part):
                here, shelf = (group, b, part), _Shelf(b, hearing)
            if not text:
                shelf.passages[at] = w or ""
            elif at in shelf.passages:  # a text whose passage isn't in the canon has no label
                taken.append(i)
                got.append(shelf.label(at, first, pos, _as_words(w)))
        at, first, pos, last, n = zip(*got, strict=True) if got else [()] * 5
        goes_on = pa.array([w if x is None else None for w, x in zip((rows["words"][i] for i in taken), n, strict=True)], pa.string())
        kept = batch.select(["_key", "group"]).take(pa.array(taken, pa.int64()))
        number = lambda x: pa.array(x, pa.int64())
        yield pa.RecordBatch.from_arrays([*kept.columns, number(at), number(first), number(pos), goes_on, number(last), number(n)], names=["_key", "group", "at", "first", "pos", "words", "last", "n_words"])


def _first(items: Column, test: Callable[[Column], Column]) -> Column:
    """The first of an array of whole numbers that passes; those after it aren't tested. Null if none does."""
    return F.aggregate(items, F.lit(None).cast("int"), lambda got, x: F.when(got.isNotNull(), got).when(test(x), x))


#: Passages of a range that meet in one bucket.
BUCKET = 16


def yield_tails(refs: DataFrame, doc: str, ref: str) -> DataFrame:
    """(doc, ref, first, last, n_words): X11. refs(doc, ref, group, first, last, words): one over a range gives up what
    another one of its document and group begins later in the range, from where the other's first four words (three at
    least) stand in its own. Of several the first by `ref` decides.

    Ranges and the places at which others begin meet in buckets of passages, not by all pairs of a group."""
    refs = materialize(refs, "refs")
    bucket = lambda c: F.floor(F.col(c) / BUCKET)
    z = refs.select(doc, "group", F.col(ref).alias("_z"), F.col("first").alias("_f"), bucket("first").alias("_b"), F.slice(F.filter("words", lambda w: w != ""), 1, 4).alias("_lead")).where(F.size("_lead") >= 3)
    over = refs.where("last > first").select(doc, "group", ref, "first", "last", "words", F.explode(F.sequence(F.floor((F.col("first") + 1) / BUCKET), bucket("last"))).alias("_b"))
    j = over.join(z, [doc, "group", "_b"]).where((F.col(ref) != F.col("_z")) & (F.col("_f") > F.col("first")) & (F.col("_f") <= F.col("last")))
    stands = lambda p: (F.get("words", p) == F.get("_lead", F.lit(0))) & (F.slice("words", p + 1, F.size("_lead")) == F.col("_lead"))
    at = _first(F.sequence(F.lit(1), F.greatest(F.size("words") - F.size("_lead"), F.lit(1))), stands)
    cut = j.withColumn("_at", at).where("_at is not null").groupBy(doc, ref).agg(F.min(F.struct("_z", "_at", "_f")).alias("c"))
    r = refs.select(doc, ref, "first", "last", F.size("words").alias("_n")).join(cut, [doc, ref], "left")
    return r.select(doc, ref, "first", F.when(F.col("c").isNotNull(), F.greatest(F.col("c._f") - 1, F.col("first"))).otherwise(F.col("last")).alias("last"), F.coalesce(F.col("c._at"), F.col("_n")).cast("long").alias("n_words"))


#: Sources of a link, the surest first, and the note of a card that stays without one.
LINK_ORDER = ("named", "both", "copy", "unnamed", "claimed", "kept")
UNLINKED = "The collection named; not found there"
NOT_HIS = "Not found among those of the person named"


def resolve_links(refs: DataFrame, candidates: DataFrame, ref: str) -> DataFrame:
    """(ref, collection, number, source, note): X15. refs(ref, named, person): the collection and the person that the speaker
    names, or null. candidates(ref, source, collection, number, score, on_chain).

    The surest source wins, then the higher score. If a collection is named, candidates of others go, those of `unnamed` and
    `claimed` too. A person who is named must be on the chain. Without a candidate the named collection stays, without a
    number, and a note says why."""
    j = refs.join(candidates, ref, "left")
    order = F.array_position(F.array(*map(F.lit, LINK_ORDER)), F.col("source"))
    fits = F.col("source").isNotNull() & (F.col("named").isNull() | ((F.col("collection") == F.col("named")) & ~F.col("source").isin("unnamed", "claimed")))
    his = F.col("person").isNull() | F.coalesce("on_chain", F.lit(True))
    best = j.groupBy(ref).agg(
        F.min(F.when(fits & his, F.struct(order.alias("o"), (-F.col("score")).alias("s"), "collection", "number", "source"))).alias("b"),
        F.first("named").alias("named"), F.bool_or(fits & ~his).alias("others"),
    )
    note = F.when(F.col("b").isNotNull(), F.lit(None).cast("string")).when(F.col("others"), NOT_HIS).when(F.col("named").isNotNull(), UNLINKED)
    return best.select(ref, F.coalesce("b.collection", "named").alias("collection"), "b.number", "b.source", note.alias("note"))


def split_location(docs: DataFrame, markers: DataFrame, gaps: DataFrame, doc: str, least: int = 40, pause: float = 1.2, near: float = 30.0) -> DataFrame:
    """(doc, word, time, via, validated): X17. docs(doc, n_words), markers(doc, word, time) and gaps(doc, word, time, gap): of
    documents of `least` words or more the marker's place, validated if the largest gap lies within `near` seconds of it;
    else the largest gap if it's `pause` or more."""
    j = docs.where(F.col("n_words") >= least).join(markers.select(doc, F.col("word").alias("m_word"), F.col("time").alias("m_time")), doc, "left").join(gaps.select(doc, F.col("word").alias("g_word"), F.col("time").alias("g_time"), "gap"), doc, "left")
    marked = F.col("m_word").isNotNull()
    time = F.coalesce("m_time", "g_time")
    sure = F.coalesce(F.abs(time - F.col("g_time")) <= near, F.lit(False))
    found = j.where(marked | (F.col("gap") >= pause))
    return found.select(doc, F.coalesce("m_word", "g_word").alias("word"), F.round(F.when(marked, time).otherwise(F.col("g_time")), 1).alias("time"), F.when(marked, "marker").otherwise("gap").alias("via"), F.when(marked, sure).otherwise(F.lit(True)).alias("validated"))


def in_passage(word: Column, passage: Column) -> Column:
    """Whether a word stands in a passage's words, one edit forgiven from four letters on."""
    return F.array_contains(passage, word) | ((F.length(word) >= 4) & F.exists(passage, lambda v: F.levenshtein(word, v, 1) >= 0))


def assemble(docs: DataFrame, chunks: DataFrame, refs: DataFrame, doc: str) -> DataFrame:
    """(doc, block, kind, start, end, chunks, refs): X21, X22. docs(doc, words), chunks(doc, chunk, start, end) and located
    refs(doc, ref, merges, passage, start, end), `passage` the words of what is quoted.

    References with half their words or more inside chunks are inline; of the others those that don't merge are cards of
    their own, between the chunks. A chunk is emitted once, if some of its words are outside the cards (X22). An inline
    reference goes to the first chunk that it overlaps. A merging one makes all chunks that it overlaps one block. Edges
    that two blocks share and words in none are settled by `reconcile`."""
    inside = refs.join(chunks.select(doc, F.col("start").alias("_s"), F.col("end").alias("_e")), doc).where("_s < end and _e > start")
    share = inside.groupBy(doc, "ref").agg(F.sum(F.least("end", "_e") - F.greatest("start", "_s")).alias("_in"))
    r = refs.join(share, [doc, "ref"], "left").withColumn("inline", F.coalesce(F.col("_in") / F.greatest(F.col("end") - F.col("start"), F.lit(1)) >= 0.5, F.lit(False)))
    r = materialize(r, "refs")
    cards = r.where("not inline and not merges").select(doc, F.lit("card").alias("kind"), "start", "end", F.array().cast("array<bigint>").alias("chunks"), F.array("ref").alias("refs"), "passage")
    covered = chunks.join(cards.select(doc, F.col("start").alias("_s"), F.col("end").alias("_e")), doc, "left")
    taken = covered.groupBy(doc, "chunk", "start", "end").agg(F.sum(F.when(F.col("_s").isNotNull(), F.greatest(F.lit(0), F.least("end", "_e") - F.greatest("start", "_s")))).alias("_t"))
    prose = taken.where(F.coalesce("_t", F.lit(0)) < F.col("end") - F.col("start")).select(doc, "chunk", "start", "end")
    # blocks that one reference spans are one: each chunk's first merging reference names its block
    merging = r.where("merges").select(doc, F.col("ref").alias("_m"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    spanned = prose.join(merging, doc).where("_s < end and _e > start").groupBy(doc, "chunk").agg(F.min("_m").alias("_m"))
    named = prose.join(spanned, [doc, "chunk"], "left")
    named = materialize(named, "prose")
    block = named.groupBy(doc, F.coalesce(F.concat(F.lit("m"), F.col("_m").cast("string")), F.concat(F.lit("c"), F.col("chunk").cast("string"))).alias("_b")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(F.col("chunk").cast("long"))).alias("chunks"))
    hosted = r.where("inline or merges").select(doc, "ref", F.col("start").alias("_s"), F.col("end").alias("_e")).join(block.select(doc, "_b", "start", "end"), doc).where("_s < end and _e > start").groupBy(doc, "ref").agg(F.min_by("_b", "start").alias("_b"))
    carried = hosted.groupBy(doc, "_b").agg(F.array_sort(F.collect_list("ref")).alias("refs"))
    kind = refs.schema["ref"].dataType.simpleString()
    none = F.array().cast(f"array<{kind}>")
    rows = block.join(carried, [doc, "_b"], "left").select(doc, F.lit("prose").alias("kind"), "start", "end", "chunks", F.coalesce("refs", none).alias("refs"), F.lit(None).cast("array<string>").alias("passage"))
    # a reference that no block hosts is a card of its own
    alone = r.where("inline or merges").join(hosted.select(doc, "ref"), [doc, "ref"], "left_anti").select(doc, F.lit("card").alias("kind"), "start", "end", F.array().cast("array<bigint>").alias("chunks"), F.array("ref").alias("refs"), "passage")
    return reconcile(materialize(rows.unionByName(cards).unionByName(alone), "segments"), docs, doc)


def reconcile(segments: DataFrame, docs: DataFrame, doc: str) -> DataFrame:
    """(doc, block, kind, start, end, chunks, refs): X19. Each word of a document in exactly one block.

    Of two blocks that overlap, prose before a card ends where the card begins; what follows a card begins where it ends.
    Words in no block go to the card before, or after, them if 0.6 of them are its passage's (one edit forgiven), else to
    prose before or after them, else they are a block of their own."""
    order = Window.partitionBy(doc).orderBy("start", "end")
    s = segments.withColumns({"_ps": F.lag("start").over(order), "_pe": F.lag("end").over(order), "_pk": F.lag("kind").over(order), "_ns": F.lead("start").over(order), "_ne": F.lead("end").over(order), "_nk": F.lead("kind").over(order)})
    over = lambda a, b: (a < b)
    begin = F.when(over(F.col("start"), F.col("_pe")) & (F.col("end") > F.col("_pe")) & (F.col("_pk") == "card"), F.col("_pe")).otherwise(F.col("start"))
    stop = F.when((F.col("kind") == "prose") & (F.col("_nk") == "card") & over(F.col("_ns"), F.col("end")) & (F.col("_ne") > F.col("end")) & (F.col("_ns") > F.col("start")), F.col("_ns")).otherwise(F.col("end"))
    s = s.withColumns({"start": begin, "end": stop}).drop("_ps", "_pe", "_pk", "_ns", "_ne", "_nk").where("start < end")
    s = materialize(s, "trimmed")
    sizes = docs.select(doc, F.size("words").cast("long").alias("_n"))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gaps = s.select(doc, F.coalesce(reach, F.lit(0)).alias("a"), F.col("start").alias("b")).where("a < b")
    tail = sizes.join(s.groupBy(doc).agg(F.max("end").alias("_e")), doc, "left").select(doc, F.coalesce("_e", F.lit(0)).alias("a"), F.col("_n").alias("b")).where("a < b")
    side = lambda col, to: s.groupBy(doc, F.col(col).alias(to)).agg(F.min_by(F.struct("start", "end", "kind", "passage"), F.struct("start", "end")).alias(f"_{col}"))
    g = gaps.unionByName(tail).join(side("end", "a"), [doc, "a"], "left").join(side("start", "b"), [doc, "b"], "left").join(docs, doc)
    said = F.filter(F.slice("words", (F.col("a") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int")), lambda w: w != "")
    of = lambda c: (F.col(f"{c}.kind") == "card") & (F.size(F.filter(said, lambda w: in_passage(w, F.col(f"{c}.passage")))) >= F.ceil(F.size(said) * SHARE))
    rule = F.when(F.coalesce(of("_end"), F.lit(False)), "before").when(F.coalesce(of("_start"), F.lit(False)), "after").when(F.col("_end.kind") == "prose", "before").when(F.col("_start.kind") == "prose", "after").otherwise("own")
    g = g.select(doc, "a", "b", rule.alias("rule"))
    grown = s.join(g.where("rule = 'before'").select(doc, F.col("a").alias("end"), F.col("b").alias("_to")), [doc, "end"], "left").join(g.where("rule = 'after'").select(doc, F.col("b").alias("start"), F.col("a").alias("_from")), [doc, "start"], "left")
    grown = grown.select(doc, "kind", F.coalesce("_from", "start").alias("start"), F.coalesce("_to", "end").alias("end"), "chunks", "refs")
    own = g.where("rule = 'own'").select(doc, F.lit("untranslated").alias("kind"), F.col("a").alias("start"), F.col("b").alias("end"), F.array().cast(s.schema["chunks"].dataType).alias("chunks"), F.array().cast(s.schema["refs"].dataType).alias("refs"))
    return grown.unionByName(own).withColumn("block", F.row_number().over(Window.partitionBy(doc).orderBy("start", "end")) - 1).select(doc, "block", "kind", "start", "end", "chunks", "refs")


def identified_gaps(spans: DataFrame, gaps: DataFrame, doc: str, least: int = 5, share: float = 0.6) -> DataFrame:
    """(doc, start, end, group, passage): X20. gaps(doc, start, end) with the longest span inside them, if it has a share of
    their words, `least` at least, or is a whole passage of three words or more. spans(doc, start, end, group, passage, size)."""
    g = gaps.select(doc, F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    inside = spans.join(g, doc).where("start >= g_start and end <= g_end")
    n = F.col("end") - F.col("start")
    good = inside.where(((F.col("size") >= 3) & (n >= F.col("size"))) | (n >= F.greatest(F.lit(least), F.ceil((F.col("g_end") - F.col("g_start")) * share))))
    best = good.groupBy(doc, "g_start", "g_end").agg(F.max(F.struct(n.alias("n"), (-F.col("start")).alias("s"), (-F.col("group")).alias("g"), (-F.col("passage")).alias("p"))).alias("b"))
    return best.select(doc, F.col("g_start").alias("start"), F.col("g_end").alias("end"), (-F.col("b.g")).alias("group"), (-F.col("b.p")).alias("passage"))


def words_in_cards(chunks: DataFrame, blocks: DataFrame, doc: str, least: int = 2) -> DataFrame:
    """(doc, chunk, n): X25. Chunks of which `least` words or more are shown in a card."""
    cards = blocks.where("kind = 'card'").select(doc, F.col("start").alias("_s"), F.col("end").alias("_e"))
    over = chunks.join(cards, doc).where("_s < end and _e > start")
    return over.groupBy(doc, "chunk").agg(F.sum(F.least("end", "_e") - F.greatest("start", "_s")).cast("long").alias("n")).where(F.col("n") >= least)


def marking_faults(cards: DataFrame, key: list[str]) -> DataFrame:
    """(key, fault): X27. cards(key, said, marked, span, excerpt_span, whole): more marked as recited than was said, by half and
    four words; an excerpt made for other words than those marked."""
    more = F.col("marked") > 1.5 * F.col("said") + 4
    stale = F.col("excerpt_span").isNotNull() & ~F.coalesce("whole", F.lit(False)) & ~F.col("excerpt_span").eqNullSafe(F.col("span"))
    faults = F.array_compact(F.array(F.when(more, "marked more than said"), F.when(stale, "stale excerpt")))
    return cards.select(*key, F.explode(faults).alias("fault"))


def label_faults(refs: DataFrame, canon: DataFrame, key: list[str], lead_in: tuple[str, ...] = ()) -> DataFrame:
    """(key, fault): X29. refs(key, group, first, last, link, words) against canon(group, passage, words): a link that isn't the
    label's; a label without a passage; under half of the words in the passages; two words or more at the end, or three but
    for lead-ins at the start, that are not theirs (one edit forgiven)."""
    named = refs.select(*key, "group", F.explode(F.sequence("first", "last")).alias("passage"))
    cited = named.join(canon.select("group", "passage", F.col("words").alias("_w")), ["group", "passage"]).groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_list("_w"))).alias("cited"))
    r = refs.join(cited, key, "left")
    own = F.transform("words", lambda w: in_passage(w, F.col("cited")))
    share = F.size(F.filter("words", lambda w: F.array_contains("cited", w))) / F.greatest(F.size("words"), F.lit(1))
    r = r.withColumn("_own", F.when(F.col("cited").isNotNull(), own))
    head = F.coalesce(F.nullif(F.array_position("_own", True), F.lit(0)), F.size("words") + 1) - 1
    tail = F.coalesce(F.nullif(F.array_position(F.reverse("_own"), True), F.lit(0)), F.size("words") + 1) - 1
    stray = F.size(F.filter(F.slice("words", F.lit(1), head.cast("int")), lambda w: ~w.isin(*lead_in))) if lead_in else head
    known = F.col("cited").isNotNull()
    faults = F.array_compact(F.array(
        F.when(F.col("link") != F.concat_ws("/", "group", "first"), "link"), F.when(~known, "no passage"), F.when(known & (share < 0.5), "other text"),
        F.when(known & (tail >= 2) & (tail < F.size("words")), "end"), F.when(known & (stray >= 3) & (head < F.size("words")), "start"),
    ))
    return r.select(*key, F.explode(faults).alias("fault"))


def chunk_starts(chunks: DataFrame, series: DataFrame, doc: str) -> DataFrame:
    """(doc, chunk, word): X39. chunks(doc, chunk, words) placed in series(doc, words), in order: from a cursor on the first place of
    their first six, four or three words, the cursor itself if there's none. The cursor goes past their last three words
    if those stand within 15 words more than the chunk has, at least one word on and over 0.6 of the chunk.

    Places are looked up in the row's own arrays of n-gram hashes; a fold over a document's own chunks moves the cursor."""
    rows = series.select(doc, F.col("words").alias("_t"))
    for k in (6, 4, 3):
        rows = rows.select("*", F.explode(F.array(F.transform(gram_hashes(F.col("_t"), k), lambda g: g["h"]))).alias(f"_h{k}"))
    listed = chunks.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("chunk", "words"))).alias("_c")).join(rows, doc)

    def place(needle: Column, k: int, lo: Column, n: Column) -> Column:
        """The first place of the needle's k words in the series among n places from lo on; null if none."""
        at = F.array_position(F.slice(f"_h{k}", F.least(lo + 1, F.size(f"_h{k}") + 1), n), F.get(gram_hashes(needle, k), F.lit(0))["h"])
        return F.when((F.size(needle) == k) & (lo < F.size(f"_h{k}")) & (at > 0), (lo + at - 1).cast("int"))

    def step(s: Column, x: Column) -> Column:
        w = F.filter(x["words"], lambda v: v != "")
        at = F.coalesce(*[place(F.slice(w, 1, k), k, s["cursor"], F.size("_t")) for k in (6, 4, 3)], s["cursor"])

        def after(at: Column) -> Column:
            tail = place(F.slice(w, F.greatest(F.size(w) - 2, F.lit(1)), F.lit(3)), 3, at, F.size(w) + 16)
            cursor = F.greatest(at + 1, F.coalesce(tail + 3, at + 1), at + F.floor(F.size(w) * 0.6).cast("int"))
            return F.struct(cursor.cast("int").alias("cursor"), F.concat(s["out"], F.array(F.struct(x["chunk"].cast("long").alias("chunk"), at.cast("long").alias("word")))).alias("out"))

        return let(at, after)

    start = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<struct<chunk:bigint,word:bigint>>").alias("out"))
    return listed.select(doc, F.explode(F.aggregate("_c", start, step, lambda s: s["out"])).alias("o")).select(doc, "o.chunk", "o.word")


def strictly_increasing(rows: DataFrame, key: str, order: str, value: str, weight: str, out: str) -> DataFrame:
    """Values that aren't above all before them lie, by weight, between the last good one and the next; past the last good
    one they go on by one a row. A run's first weight is that of the good row before it."""
    w = Window.partitionBy(key).orderBy(order)
    top = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = rows.withColumn("_good", F.coalesce(F.col(value) > top, F.lit(True)))
    r = r.withColumn("_run", F.sum(F.when(F.col("_good"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    t0 = F.last(F.when(F.col("_good"), F.col(value)), ignorenulls=True).over(back)
    nxt = F.first(F.when(F.col("_good"), F.col(value)), ignorenulls=True).over(ahead)
    own = Window.partitionBy(key, "_run").orderBy(order)
    size = F.count(F.lit(1)).over(Window.partitionBy(key, "_run"))
    r = r.withColumns({"_t0": t0, "_t1": nxt, "_n": size, "_i": F.row_number().over(own) - 1, "_all": F.sum(F.greatest(F.lit(1), weight)).over(Window.partitionBy(key, "_run")), "_acc": F.coalesce(F.sum(F.greatest(F.lit(1), weight)).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    t1 = F.coalesce("_t1", F.col("_t0") + F.col("_n"))
    between = F.col("_t0") + (t1 - F.col("_t0")) * F.col("_acc") / F.col("_all")
    return r.withColumn(out, F.when(F.col("_good"), F.col(value)).otherwise(half_up(between, 1))).drop("_good", "_run", "_t0", "_t1", "_n", "_i", "_all", "_acc")


def continued(refs: DataFrame, doc: str, block: str) -> DataFrame:
    """refs(doc, block, group, first, last) with `continues`: W24. Whether the last reference of the block before is of the same
    group and this one begins inside its range or right after it."""
    w = Window.partitionBy(doc).orderBy(block)
    prev = F.lag(F.struct("group", "first", "last", F.col(block).alias("b"))).over(w)
    r = refs.withColumn("_p", prev)
    goes = (F.col("_p.b") == F.col(block) - 1) & (F.col("_p.group") == F.col("group")) & F.col("first").between(F.col("_p.first"), F.col("_p.last") + 1)
    return r.withColumn("continues", F.coalesce(goes, F.lit(False))).drop("_p")


def made_up_speech(words: DataFrame, frames: DataFrame, key: str, gap: float = 1.2, least: float = 1.5, frame: float = 0.02) -> DataFrame:
    """(key, start, end, seconds): W25. words(key, start, end) and frames(key, t, level): of the gaps of `gap` seconds or more
    between words the one with the most sound in it, if `least` seconds or more. A frame sounds above a tenth of the upper
    median of a key's frames over 200.

    Frames and words are one sorted series: each frame falls to the gap that the last word before it opens."""
    w = Window.partitionBy(key).orderBy("start", "end")
    gaps = words.withColumn("_next", F.lead("start").over(w)).where(F.col("_next") - F.col("end") >= gap).select(key, F.col("end").alias("t"), F.struct(F.col("end").alias("a"), F.col("_next").alias("b")).alias("g"))
    loud = frames.where("level > 200").withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("level"))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    level = loud.where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select(key, (F.col("level") / 10).alias("_least"))
    both = frames.select(key, "t", "level").unionByName(gaps, allowMissingColumns=True)
    held = both.withColumn("_g", F.last("g", ignorenulls=True).over(Window.partitionBy(key).orderBy("t", F.col("g").isNull()).rowsBetween(Window.unboundedPreceding, 0)))
    voice = held.where("level is not null and t < _g.b").join(level, key).where(F.col("level") > F.col("_least"))
    n = voice.groupBy(key, F.col("_g.a").alias("start"), F.col("_g.b").alias("end")).agg(F.round(F.count(F.lit(1)) * frame, 2).alias("seconds")).where(F.col("seconds") >= least)
    return n.groupBy(key).agg(F.max(F.struct("seconds", (-F.col("start")).alias("s"), "end")).alias("m")).select(key, (-F.col("m.s")).alias("start"), F.col("m.end").alias("end"), F.col("m.seconds").alias("seconds"))


def matched_blocks(blocks: DataFrame, others: DataFrame, doc: str, number: str, text: str, look: int = 4) -> DataFrame:
    """(doc, number, other): J29. Blocks with the block of another language's rows that has the same text, in order, looking
    `look` rows ahead of the last match. The blocks' own order is the other's; a fold over a document's own rows."""
    a = blocks.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(number, F.xxhash64(text).alias("h")))).alias("_a"))
    b = others.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(number, F.xxhash64(text).alias("h")))).alias("_b"))
    start = F.struct(F.lit(0).alias("j"), F.array().cast("array<struct<n:bigint,o:bigint>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        k = F.array_position(F.transform(F.slice("_b", s["j"] + 1, F.lit(look)), lambda y: y["h"]), x["h"])
        hit = F.struct((s["j"] + k).cast("int").alias("j"), F.concat(s["out"], F.array(F.struct(x[number].cast("long").alias("n"), F.get("_b", (s["j"] + k - 1).cast("int"))[number].cast("long").alias("o")))).alias("out"))
        return F.when(k > 0, hit).otherwise(s)

    return a.join(b, doc).select(doc, F.explode(F.aggregate("_a", start, step, lambda s: s["out"])).alias("m")).select(doc, F.col("m.n").alias(number), F.col("m.o").alias("other"))


def fresh_tracks(manifest: DataFrame, blocks: DataFrame, doc: str, track: str, number: str, head: str, text: str, n: int = 6) -> DataFrame:
    """(doc, track): J30. Tracks of which every row's head is the first n words of the block of its number as it is now."""
    now = blocks.select(doc, number, F.array_join(F.slice(words(F.col(text)), 1, n), " ").alias("_now"))
    return manifest.join(now, [doc, number], "left").groupBy(doc, track).agg(F.bool_and(F.coalesce(F.col(head) == F.col("_now"), F.lit(False))).alias("ok")).where("ok").select(doc, track)


def same_number(asked: DataFrame, known: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """(key, id, score): J19. asked(key, number, collection, pairs), known(id, number, other, collection, pairs): of a
    collection's rows with the number, or the whole part of the other number, the one that has most of the word pairs
    asked for, if `least` of them; where no row has the number, of all rows of the collection that share a pair."""
    k = known.select("id", "collection", F.col("number").alias("_n"), F.get(F.split("other", r"\."), F.lit(0)).alias("_o"), F.col("pairs").alias("_k"))
    by = asked.join(k.select("id", "collection", F.explode(F.array_distinct(F.array("_n", "_o"))).alias("number")).distinct(), ["collection", "number"]).select(key, "id").distinct()
    rest = asked.join(by.select(key).distinct(), key, "left_anti").select(key, "collection", F.explode("pairs").alias("p"))
    share = rest.join(k.select("id", "collection", F.explode("_k").alias("p")), ["collection", "p"]).select(key, "id").distinct()
    j = by.unionByName(share).join(asked.select(key, "pairs"), key).join(k.select("id", "_k"), "id")
    score = F.size(F.array_intersect("pairs", "_k")) / F.greatest(F.size(F.array_distinct("pairs")), F.lit(1))
    s = j.withColumn("score", score).where(F.col("score") >= least)
    return s.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), "id"))).where("_r = 1").select(key, "id", "score")


def neighbour_guard(rows: DataFrame, key: str, order: str, text: str, fix: str) -> DataFrame:
    """rows with `verdict`: X32. A correction is applied if its length is 0.5 to 1.8 times the text's, unless that is because
    it removes a neighbour's words, and if it doesn't repeat a neighbour."""
    from quotary.functions.cards import removes_neighbour, repeats_neighbour

    w = Window.partitionBy(key).orderBy(order)
    r = rows.withColumns({"_p": F.lag(text).over(w), "_n": F.lead(text).over(w)})
    a, b = F.size(words(F.col(text))), F.size(words(F.col(fix)))
    cut = let(F.array_compact(F.array("_p", "_n")), lambda n: removes_neighbour(F.col(text), F.col(fix), n))
    bad = ((b < 0.5 * a) & ~F.coalesce(cut, F.lit(False))) | (b > 1.8 * a)
    return r.withColumn("verdict", F.when(F.col(fix).isNull(), "none").when(bad, "length").when(repeats_neighbour(F.col(text), F.col(fix), F.col("_p"), F.col("_n")), "neighbour").otherwise("applied")).drop("_p", "_n")


def reviewed(rows: DataFrame, corrections: DataFrame, key: str, order: str, text: str, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """(rows with the last `text`, log(key, order, round, severity, verdict)): X32. Rounds of corrections(key, order, round, fix, severity): the first is over
    all rows, each later one over those alone that the round before changed, until none is changed or `rounds` are over.

    A correction of severity `low`, without a text or equal to its row's is not applied (`low`, `none`, `same`); others pass neighbour_guard, whose
    neighbours are those at the beginning of the round. Each row has one correction a round at most."""
    texts, review, log = rows, rows.select(key, order), None
    for number in range(1, rounds + 1):
        asked = corrections.where(F.col("round") == number).join(review, [key, order], "left_semi").select(key, order, F.col("fix").alias("_fix"), "severity")
        if asked.isEmpty():
            break
        held = neighbour_guard(texts.join(asked, [key, order], "left"), key, order, text, "_fix")
        serious = F.coalesce(F.col("severity") != "low", F.lit(False))
        verdict = F.when(~serious, "low").when(F.trim("_fix") == "", "none").when(F.col("_fix") == F.col(text), "same").otherwise(F.col("verdict"))
        judged = materialize(held.withColumn("_v", F.when(F.col("severity").isNotNull(), verdict)), "reviewed")
        entry = judged.where("_v is not null").select(key, order, F.lit(number).alias("round"), "severity", F.col("_v").alias("verdict"))
        log = entry if log is None else log.unionByName(entry)
        texts = judged.select(*[F.when(F.col("_v") == "applied", F.col("_fix")).otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in rows.columns])
        review = judged.where("_v = 'applied'").select(key, order)
    return texts, log if log is not None else rows.sparkSession.createDataFrame([], f"{key} {dict(rows.dtypes)[key]}, {order} {dict(rows.dtypes)[order]}, round int, severity string, verdict string")
