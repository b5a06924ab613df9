"""Repeated passages by hashes of normalised units and of word windows.

A unit is a sentence of a line; a window is any `min_run_words` words in a row.  Both are lower-cased
and hashed, the hashes are grouped over the corpus, and the occurrence of least rank
`(doc_id, row, place)` of each is kept.  Runs of touching repeats that are long enough are
removed; their offsets in the original text stay with the result.

Windows give a passage its true word bounds wherever its ends lie.  The least hash of the shorter word
groups in a window follows from its words, so equal windows have it in common, and neighbouring
windows with one least hash form a stretch.  A first pass counts units and least hashes and compares the
stretches of each.  What is found once has no equal and is never moved; where all stretches of a least hash are
equal, each is one piece; else their windows are.  Bitmaps of both kinds travel to the tasks.  They grow with
what is repeated up to a fixed size; a chance hit holds for all windows of a least hash alike, so it costs work, not results.

Pieces move once, dealt by unit or least hash with the windows of a stretch in one row.  Each task sorts
its groups, and what goes on is repeats only, neighbouring windows joined.  A hash that is a large share of all
is dealt to many tasks, whose first occurrences are then compared.  What repeats the first of its task repeats the first
of all, so only these first ones are compared; the document that keeps the first of all is looked up once for each span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusengine.llm.common import ROW, col, numbered, text_of
from corpusengine.session import materialize, small_side

#: Words that a run of repeated units needs to be removed.
MIN_RUN_WORDS = 25
#: A unit ends at a line end, or at white space after a sentence end and what closes it.
ENDS, CLOSERS = ".!?…。！？", "\"')]”’»"
SPACE, END, CLOSER = 1, 2, 3
_CLASS = np.array([SPACE if chr(i).isspace() else END if chr(i) in ENDS else CLOSER if chr(i) in CLOSERS else 0 for i in range(1 << 16)], np.uint8)
#: What a piece is: a sentence, a window or stretch of them, or windows of one group of words over and over.
UNIT, WINDOW, PERIODIC = 0, 1, 2
#: `words` holds first word, number of words and kind, `parts` the hashes of its windows, then their first characters and lengths.
PIECE_KINDS = f"{ROW} long, doc_id long, hash long, salt int, words long, parts array<long>"
#: Hash and key are there for hashes dealt to many tasks; then `kept_*` is the first of the task, for what may not repeat it.
FOUND_KINDS = f"{ROW} long, doc_id long, words long, chars long, kept_doc_id long, kept_row long, kept_word long, hash long, key long"
SPAN_KINDS = f"{ROW} long, doc_id long, start long, end long, n_units long, n_words long, kept_doc_id long"
#: Bits of a map for each hash in it, at most so many in all, and of one row of it; bits of a hash that the first pass compares.
BITS_EACH, MAP_BITS, ROW_BITS, HASH_BITS = 16, 1 << 29, 1 << 15, 40
#: A hash with this share of what is repeated, and so many occurrences, is dealt to `SALTS` tasks.
HOT_SHARE, HOT_ROWS, SALTS = 1000, 2000, 256
#: Texts and characters that are cut at a time, rows of one record batch.
PART_TEXTS, PART_CHARS, BATCH_ROWS = 200, 1 << 20, 20_000
_BASE = 0x9E3779B97F4A7C13


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sums:
    """Hashes of runs of neighbours of `h`, as differences of prefix sums of a polynomial modulo 2 ** 64."""

    def __init__(self, h: np.ndarray):
        self.power = np.cumprod(np.full(len(h), _BASE, np.uint64))
        inverse = np.cumprod(np.full(len(h), pow(_BASE, -1, 1 << 64), np.uint64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * inverse)])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        total = (self.sums[start + size] - self.sums[start]) * self.power[start]
        return _mixed(total + np.asarray(size).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _least(g: np.ndarray, size: int) -> np.ndarray:
    """The least of each `size` neighbours of `g`."""
    width = 1
    while 2 * width <= size:
        g, width = np.minimum(g[:-width], g[width:]), 2 * width
    return np.minimum(g[: len(g) - size + width], g[size - width :])


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it in any of the columns."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


class Words:
    """The words of some texts, and the units they form.

    Of words, over all texts: `doc`, `word` (place in its text), `start` and `end` (code points of its text), `h` (hash).
    Of units: `first` (word), `count`, `unit_start`, `unit_end`, `unit_hash`.
    """

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts)
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = _CLASS[np.minimum(code, len(_CLASS) - 1)]
        edge = np.diff(np.concatenate([[True], kind == SPACE, [True]]).astype(np.int8))
        start, end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
        at = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        self.doc = np.searchsorted(at, start, "right") - 1
        first = np.searchsorted(self.doc, np.arange(len(texts)))
        self.word = np.arange(len(start)) - first[self.doc]
        self.start, self.end = start - at[self.doc], end - at[self.doc]
        flat = np.empty(len(start), object)
        flat[:] = joined.lower().split()
        self.h = pd.util.hash_array(flat) if len(flat) else np.empty(0, np.uint64)
        self.sums, self.more = Sums(self.h), Sums(_mixed(self.h))

        lines = np.concatenate([[-1], np.nonzero(code == 10)[0], [len(code)]])
        line = np.searchsorted(lines, start)
        begin, until = lines[line - 1] + 1, lines[line]
        # A sentence end at the very start of a line has nothing before it to end.
        open_to = np.maximum.accumulate(np.where(kind == CLOSER, 0, np.arange(len(kind))))[end - 1]
        stop = (kind[open_to] == END) & (open_to > begin) if len(start) else np.zeros(0, bool)
        opens = _heads(line)
        opens[1:] |= stop[:-1]
        self.first = np.nonzero(opens)[0]
        self.count = np.diff(np.append(self.first, len(start)))
        last, shift = self.first + self.count - 1, at[self.doc[self.first]]
        leads = _heads(line)[self.first]
        self.unit_start = np.where(leads, begin[self.first], end[self.first - 1]) - shift if len(start) else start
        self.unit_end = np.where(stop[last], end[last], until[last]) - shift
        self.unit_hash = _mixed(~self.sums.of(self.first, self.count))


class Windows:
    """All windows of `size` words of some texts, and their stretches.

    Of windows: `at` (first word, over all texts).  Of stretches: `first` (window), `count`, `least`.
    """

    def __init__(self, words: Words, size: int):
        self.words, self.size, self.group = words, size, (size + 1) // 2
        self.at = self.first = self.count = np.empty(0, np.int64)
        self.least = np.empty(0, np.uint64)
        n, doc = len(words.h), words.doc
        self.at = np.nonzero(doc[: n - size + 1] == doc[size - 1 :])[0] if n >= size else self.at
        if not len(self.at):
            return
        groups = words.sums.of(np.arange(n - self.group + 1), self.group)
        least = _least(groups, size - self.group + 1)[self.at]
        self.first = np.nonzero(_heads(least, doc[self.at]))[0]
        self.count, self.least = np.diff(np.append(self.first, len(least))), least[self.first]

    def stretches(self) -> tuple[np.ndarray, np.ndarray]:
        """`(least, hash)` of each stretch; with a second hash if its own windows may be equal or are periodic."""
        if not len(self.at):
            return self.least, self.least
        whole = self.words.sums.of(self.at[self.first], self.count + self.size - 1)
        periodic = np.logical_or.reduceat(self.periodic(np.arange(len(self.at))), self.first)
        own = np.nonzero(periodic | (self.count > self.size - self.group + 1))[0]
        return np.concatenate([self.least, self.least[own]]), np.concatenate([whole, ~whole[own]])

    def periodic(self, window: np.ndarray) -> np.ndarray:
        """Whether the words of the windows repeat after at most half the window."""
        out, at, h = np.zeros(len(window), bool), self.at[window], self.words.h
        for p in range(1, self.size // 2 + 1):
            same = np.concatenate([[0], np.cumsum(h[p:] == h[:-p])])
            out |= same[at + self.size - p] - same[at] == self.size - p
        return out


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of the batches with their texts, of bounded length unless one text is longer."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            texts, chars = [], 0
            while at + len(texts) < batch.num_rows and len(texts) < PART_TEXTS and chars < PART_CHARS:
                texts.append(batch.column(column)[at + len(texts)].as_py().decode("utf-8", "replace"))
                chars += len(texts[-1])
            yield batch.slice(at, len(texts)), texts
            at += len(texts)


def _short(hashes: np.ndarray) -> np.ndarray:
    """The bits of hashes that are compared in the first pass and looked up."""
    return (hashes & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64)


def least_maps(docs: DataFrame, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bitmaps of units and least hashes, of those that occur more than once and of those with unequal stretches; the hot ones."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _texts(batches, 0):
            words = Words(texts)
            least, whole = Windows(words, size).stretches()
            hashes = np.concatenate([_short(least), _short(words.unit_hash)])
            # 48 bits tell the stretches of one hash apart.
            wholes = np.concatenate([(whole >> np.uint64(16)).astype(np.int64), np.zeros(len(words.first), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(wholes)], ["hash", "whole"])

    counted = materialize(
        docs.select(text_of(text).cast("binary").alias("text")).mapInArrow(cut, "hash long, whole long")
        .groupBy("hash").agg(F.count("*").alias("n"), F.min("whole").alias("low"), F.max("whole").alias("high"))
        .where("n > 1").select("hash", "n", (F.col("low") != F.col("high")).alias("varied")),
        "repeated-hashes",
    )
    found = counted.agg(F.count("*").alias("n"), F.sum("n").alias("rows")).first()
    bits = min(MAP_BITS, max(ROW_BITS, 1 << (BITS_EACH * found["n"]).bit_length()))
    hot = counted.where(F.col("n") >= max(HOT_ROWS, (found["rows"] or 0) // HOT_SHARE)).select("hash").collect()
    # Each row of a map is made in one task, from the places of its bits.
    place = F.col("hash").bitwiseAND(F.lit(bits - 1)) + 1
    rows = (
        counted.select(F.explode(F.when(F.col("varied"), F.array(place, place + bits)).otherwise(F.array(place))).alias("place"))
        .select(F.bitmap_bucket_number("place").alias("row"), F.bitmap_bit_position("place").alias("bit"))
        .repartition("row").groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    out = np.zeros((2 * bits // ROW_BITS, ROW_BITS // 8), np.uint8)
    for r in rows.collect():
        out[r["row"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(2, -1), np.sort(np.array([r["hash"] for r in hot], np.int64))


def _packed(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(np.int64) << 32) | low


def _unpacked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x >> 32, x & 0xFFFFFFFF


def _pieces_of(words: Words, size: int, maps: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Pieces that may have an equal: `(first word, over all texts; hash; words of each; kind; windows; keys, characters of each window)`."""
    of = words.more.of
    bit = _short(words.unit_hash) & (8 * maps.shape[1] - 1)
    unit = np.nonzero((maps[0][bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)[0]
    first, n = words.first[unit], words.count[unit]
    chars = _packed(words.unit_start[unit], words.unit_end[unit] - words.unit_start[unit])
    yield first, words.unit_hash[unit], n, np.full(len(unit), UNIT), np.ones(len(unit), np.int64), of(first, n), chars

    windows = Windows(words, size)
    bit = _short(windows.least) & (8 * maps.shape[1] - 1)
    repeated, varied = ((m[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 for m in maps)

    def span(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return _packed(words.start[first], words.end[last] - words.start[first])

    # The stretches that stay whole, and each window of the others.
    whole = np.nonzero(repeated & (1 - varied))[0]
    first, n = windows.at[windows.first[whole]], size - 1 + windows.count[whole]
    yield first, windows.least[whole], n, np.full(len(whole), WINDOW), np.ones(len(whole), np.int64), of(first, n), span(first, first + n - 1)

    split = np.nonzero(repeated & varied)[0]
    times = windows.count[split]
    window = np.repeat(windows.first[split], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    if not len(window):
        return
    least, first = np.repeat(windows.least[split], times), windows.at[window]
    key, over = of(first, size), windows.periodic(window)
    # Equal periodic windows that touch are one piece, as they are repeats together or not at all.
    at, k, h = first[over], key[over], least[over]
    order = np.lexsort([at, k, words.doc[at]])
    at, k, h = at[order], k[order], h[order]
    heads = _heads(words.doc[at], k)
    heads[1:] |= np.diff(at) > size
    lead = np.nonzero(heads)[0]
    last = at[np.append(lead[1:], len(at)) - 1] + size - 1 if len(lead) else at
    n = last - at[lead] + 1
    yield at[lead], h[lead], n, np.full(len(lead), PERIODIC), np.ones(len(lead), np.int64), k[lead], span(at[lead], last)

    # Neighbouring windows of a stretch are one row.
    plain = ~over
    first, key, least = first[plain], key[plain], least[plain]
    heads = _heads(least, words.doc[first])
    heads[1:] |= np.diff(first) != 1
    lead = np.nonzero(heads)[0]
    count = np.diff(np.append(lead, len(first)))
    yield first[lead], least[lead], np.full(len(lead), size), np.full(len(lead), WINDOW), count, key, span(first, first + size - 1)


def pieces(docs: DataFrame, text: str = "text", size: int = MIN_RUN_WORDS) -> tuple[DataFrame, bool]:
    """The units, windows and stretches that may have an equal; columns as in `PIECE_KINDS`.  Whether any hash is hot."""
    maps, hot = least_maps(docs, text, size)
    found = docs.sparkSession.sparkContext.broadcast((maps, hot))
    names = [part.split(" ")[0] for part in PIECE_KINDS.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps, hot = found.value
        for part, texts in _texts(batches, 2):
            words = Words(texts)
            for first, h, n, kind, count, key, chars in _pieces_of(words, size, maps):
                if not len(first):
                    continue
                doc = words.doc[first]
                ids = part.column(0).to_numpy()[doc]
                salt = np.where(np.isin(_short(h), hot), 1 + ids % SALTS, 0) if len(hot) else np.zeros(len(h), np.int64)
                # The keys of a row, then the characters of its windows.
                at = 2 * (np.cumsum(count) - count)
                place = np.arange(count.sum()) + np.repeat(at // 2, count)
                parts = np.empty(2 * count.sum(), np.int64)
                parts[place], parts[place + np.repeat(count, count)] = key.view(np.int64), chars
                batch = pa.RecordBatch.from_arrays(
                    [pa.array(ids), part.column(1).take(pa.array(doc)), pa.array(h.view(np.int64)), pa.array(salt.astype(np.int32)),
                     pa.array(_packed(words.word[first], n << 2 | kind)), pa.ListArray.from_arrays(pa.array(np.append(at, len(parts)).astype(np.int32)), pa.array(parts))],
                    names,
                )
                for i in range(0, len(first), BATCH_ROWS):
                    yield batch.slice(i, BATCH_ROWS)

    rows = numbered(docs, col("doc_id").cast("long").alias("doc_id"), text_of(text).cast("binary").alias("text"))
    return rows.mapInArrow(cut, PIECE_KINDS), len(hot) > 0


def _repeats(apart_from: int, kind, row, word, kept_row, kept_word):
    """Whether a piece repeats the first one of its key; for columns and arrays alike."""
    inside = ((kind == UNIT) & (word != kept_word)) | ((kind == WINDOW) & (word >= kept_word + apart_from))
    return (row != kept_row) | inside


def _found(table: pa.Table, size: int) -> pa.RecordBatch:
    """Repeats among the pieces of a task, neighbouring windows joined; of hot hashes also the other pieces, each by itself.

    A row's pieces of a hot hash are in one task.  So a repeat of the first of its task is one of the first of all: that
    is the same piece, or it comes before it in another row than the repeat's.
    """
    row, h, salt, words = (table.column(c).combine_chunks().to_numpy() for c in (ROW, "hash", "salt", "words"))
    doc = table.column("doc_id").combine_chunks()
    no_id, doc_id = doc.is_null().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy()
    parts = table.column("parts").combine_chunks()
    values, lengths = parts.flatten().to_numpy(), parts.value_lengths().to_numpy().astype(np.int64)
    count = lengths // 2
    piece = np.repeat(np.arange(len(row)), count)
    begin = np.cumsum(count) - count
    nth = np.arange(len(piece)) - begin[piece]
    place = np.arange(len(piece)) + begin[piece]
    key, chars = values[place], values[place + count[piece]]
    first, low = _unpacked(words)
    word, n, kind = first[piece] + nth, (low >> 2)[piece], (low & 3)[piece]

    order = np.lexsort([word, row[piece], doc_id[piece], no_id[piece], key, salt[piece], h[piece]])
    heads = _heads(h[piece][order], salt[piece][order], key[order])
    kept = np.empty(len(piece), np.int64)
    kept[order] = order[np.nonzero(heads)[0]][np.cumsum(heads) - 1]
    hot = salt[piece] > 0
    repeated = _repeats(size, kind, row[piece], word, row[piece[kept]], word[kept])
    # A run of neighbouring windows is one piece, kept by who keeps its first one.
    chosen = np.nonzero(hot | repeated)[0]
    alone = ~repeated[chosen]
    opens = _heads(piece[chosen]) | alone
    opens[1:] |= (np.diff(chosen) != 1) | alone[:-1]
    lead = np.nonzero(opens)[0]
    a, b = chosen[lead], chosen[np.append(lead[1:], len(chosen)) - 1] if len(lead) else chosen
    start, (end, long) = chars[a] >> 32, _unpacked(chars[b])
    by, cold, known = kept[a], ~hot[a], repeated[a]
    columns = [
        pa.array(row[piece[a]]), doc.take(pa.array(piece[a])), pa.array(_packed(word[a], (word[b] - word[a] + n[b]) << 2 | kind[a])),
        pa.array(_packed(start, end + long - start)), doc.take(pa.array(piece[by], mask=known & ~cold)),
        *(pa.array(x, mask=known) for x in (row[piece[by]], word[by])), *(pa.array(x, mask=cold) for x in (h[piece[a]], key[a])),
    ]
    return pa.RecordBatch.from_arrays(columns, [part.split(" ")[0] for part in FOUND_KINDS.split(", ")])


def first_of_equals(placed: DataFrame, size: int) -> DataFrame:
    """Repeats of `pieces`, and what may be one of hot hashes, with the first of their task; columns as in `FOUND_KINDS`."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Groups come one behind the other; the last one may go on in the next batch.
        held = []
        for batch in batches:
            h, salt = (batch.column(i).to_numpy() for i in (2, 3))
            heads = _heads(h, salt)
            if held:
                before = held[-1]
                heads[:1] = (before.column(2)[-1].as_py(), before.column(3)[-1].as_py()) != (h[0], salt[0]) if len(h) else True
            at = np.nonzero(heads)[0]
            if not len(at):
                held += [batch] if batch.num_rows else []
                continue
            whole = [*held, batch.slice(0, at[-1])]
            if sum(b.num_rows for b in whole):
                yield _found(pa.Table.from_batches(whole), size)
            held = [batch.slice(at[-1])]
        if held:
            yield _found(pa.Table.from_batches(held), size)

    return placed.repartition("hash", "salt").sortWithinPartitions("hash", "salt").mapInArrow(cut, FOUND_KINDS)


def repeated_spans(docs: DataFrame, text: str = "text", min_run_words: int = MIN_RUN_WORDS) -> DataFrame:
    """Spans to remove; columns as in `SPAN_KINDS`, with the document that keeps the first of its pieces.

    `docs` is a table.  A row is a document of its own; rank is `doc_id`, nulls last, then the
    row's place in the table, then the place in the text, so repeats inside a text go too.  Null
    and empty texts have no units.  `n_units` counts the whole repeated units of a span.

    Inside one text, a window repeats only one that it does not overlap, and a periodic one
    repeats none: a word said a thousand times is one long unit, no passage and its copies.

    A hash with a thousandth of all that is repeated is dealt to many tasks.  The least of their first
    occurrences, a row for each key, is joined back to these and to the spans, by broadcast where they are few.
    """
    size = max(1, min_run_words)
    placed, any_hot = pieces(docs, text, size)
    found = first_of_equals(placed, size)
    # With a hash, `kept` is the key of a piece whose first one is looked up, else the document that keeps it.
    none = F.lit(None).cast("long")
    if any_hot:
        found = materialize(found, "found-pieces")
        rank = F.struct(F.col("kept_doc_id").isNull().alias("no_id"), "kept_doc_id", "kept_row", "kept_word")
        unsure = found.where("kept_row IS NOT NULL")
        firsts = small_side(materialize(unsure.groupBy("hash", "key").agg(F.min(rank).alias("first")), "first-pieces"))
        unsure = unsure.drop("kept_doc_id", "kept_row", "kept_word").join(firsts, ["hash", "key"])
        kind, word = F.col("words").bitwiseAND(F.lit(3)), F.shiftright("words", 32)
        unsure = unsure.where(_repeats(size, kind, F.col(ROW), word, F.col("first.kept_row"), F.col("first.kept_word")))
        kept = F.when(F.col("hash").isNull(), F.col("kept_doc_id")).otherwise(F.col("key"))
        repeats = (
            found.where("kept_row IS NULL").select(ROW, "doc_id", "words", "chars", kept.alias("kept"), "hash")
            .unionByName(unsure.select(ROW, "doc_id", "words", "chars", F.col("first.kept_doc_id").alias("kept"), none.alias("hash")))
        )
    else:
        repeats = found.select(ROW, "doc_id", "words", "chars", F.col("kept_doc_id").alias("kept"), none.alias("hash"))
    by_row = repeats.groupBy(ROW, "doc_id").agg(F.collect_list(F.struct("words", "chars", "kept", "hash")).alias("pieces"))

    kinds = f"{SPAN_KINDS}, hash long"

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split(" ")[0] for part in kinds.split(", ")]
        for batch in batches:
            out = []
            for row, doc, value in zip(*(batch.column(i) for i in range(3)), strict=True):
                *parts, kept, hashes = value.values.flatten()
                (word, low), (start, long) = (_unpacked(x.to_numpy()) for x in parts)
                order = np.lexsort([low & 3, word])
                word, low, start, long = (x[order] for x in (word, low, start, long))
                n_words, kind, end = low >> 2, low & 3, start + long
                reach = np.maximum.accumulate(word + n_words)
                first = np.concatenate([[0], np.nonzero(word[1:] > reach[:-1])[0] + 1])
                last = np.append(first[1:], len(word)) - 1
                spans = zip(
                    np.minimum.reduceat(start, first), np.maximum.reduceat(end, first),
                    np.add.reduceat((kind == UNIT).astype(np.int64), first), reach[last] - word[first], order[first], strict=True,
                )
                out += [
                    (row.as_py(), doc.as_py(), a, b, n, words, kept[int(at)].as_py(), hashes[int(at)].as_py())
                    for a, b, n, words, at in spans
                    if words >= min_run_words
                ]
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    spans = by_row.mapInArrow(runs, kinds)
    if any_hot:
        # Spans without a hash have a row number in its place, which spreads them; what they may meet is not used.
        asked = firsts.select(F.col("hash").alias("asked_hash"), F.col("key").alias("asked_key"), F.col("first.kept_doc_id").alias("first_doc_id"))
        same = (F.coalesce("hash", ROW) == F.col("asked_hash")) & (F.col("kept_doc_id") == F.col("asked_key"))
        kept = F.when(F.col("hash").isNull(), F.col("kept_doc_id")).otherwise(F.col("first_doc_id"))
        spans = spans.join(asked, same, "left").withColumn("kept_doc_id", kept)
    return spans.select(*[part.split(" ")[0] for part in SPAN_KINDS.split(", ")])


def without_repeats(docs: DataFrame, text: str = "text", min_run_words: int = MIN_RUN_WORDS) -> DataFrame:
    """`(doc, kept, removed)` of every row: its columns, the text left, and the spans `(start, end)` removed."""
    spans = (
        repeated_spans(docs, text, min_run_words)
        .groupBy(ROW)
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed"))
    )
    whole = numbered(docs, F.struct(*[col(c) for c in docs.columns]).alias("doc"), text_of(text).alias("t"))
    joined = whole.join(spans, ROW, "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<struct<start:bigint,end:bigint>>")))
    # What lies between the end of each span and the start of the next.
    bounds = F.concat(
        F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))),
        F.col("removed"),
        F.array(F.struct(F.length("t").cast("long").alias("start"), F.lit(0).cast("long").alias("end"))),
    )
    return joined.withColumn("bounds", bounds).select(
        "doc",
        F.array_join(
            F.transform(
                F.sequence(F.lit(1), F.size("removed") + 1),
                lambda i: F.substring(
                    F.col("t"),
                    F.get("bounds", i - 1)["end"].cast("int") + 1,
                    (F.get("bounds", i)["start"] - F.get("bounds", i - 1)["end"]).cast("int"),
                ),
            ),
            "",
        ).alias("kept"),
        "removed",
    )
