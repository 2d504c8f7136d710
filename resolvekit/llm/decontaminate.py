"""Benchmark decontamination by templates.

A text becomes a row of template tokens: words without outer punctuation, lower-cased, with numbers, names
(capitalised within a sentence) and units (after a number) replaced by typed placeholders. Windows of WIDTH
tokens, at least half of them words, are hash-joined between documents and benchmark items. Where an item's
windows occur in a document, the values in the placeholders must correspond: an item's value stands for one
value of the document, as in a question whose names and numbers were changed throughout. This is judged for each
occurrence alone, so that a document may hold an item several times, each time with other values.

In languages that write every noun with a capital (NOUN_WORDS tell) most names are nouns, and texts that share only
their grammar have other ones. There half of the names must be the item's own.

An item with fewer than SURE windows (short, or dense in numbers, names and units) is also looked for as it stands:
the hash of its whole token sequence, values included, is joined to the documents' sequences of that length.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .filters import BITS, bit_table, contains, without
from .store import keep, release, share, small_batches, unused
from .text import Words, mix, ngrams, pieces, powers

WIDTH = 8
#: Share of an item's windows that a document must have; share of slot values that must correspond.
COVER, CONSISTENT = 1 / 3, 0.8
#: From as many windows on, an item keeps a COVER of them where one word is read as another kind than in the document.
SURE = 3 * WIDTH // 2
#: Share of the names that must stay where nouns have capitals; such words of theirs that a text has at least.
SAME_NOUNS, LEAST_NOUN_WORDS = 0.5, 2
#: Tokens that an item has at least for what holds it, as it stands, to be removed; shorter ones are only reported.
LEAST_TOKENS = 4
#: Words that tell a language that writes nouns with capitals (German).
NOUN_WORDS = "der das dem ein eine einen einem einer und ist nicht zum zur mit auf für hat haben wie viele wird".split()
#: Unit words that are placeholders after a number, in English, German, French and Spanish.
UNITS = "km m cm mm miles mile feet foot inches inch kg g mg tons pounds ounces liters litres l ml hours hour minutes minute seconds second days day weeks week months month years year dollars dollar euros euro cents percent degrees meters metres kilometers kilograms grams".split()
UNITS += "stunde stunden minuten sekunde sekunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren cent prozent grad meter metern kilometer kilometern kilogramm gramm liter".split()
UNITS += "heure heures seconde secondes jour jours semaine semaines mois an ans année années centimes degrés mètre mètres kilomètre kilomètres gramme grammes kilogrammes litre".split()
UNITS += "hora horas minuto minutos segundo segundos día días semana semanas mes meses año años dólares céntimos grados metro metros kilómetro kilómetros gramo gramos kilogramos litro litros".split()
NUM, NAME, UNIT = (np.uint64(k) for k in (0x11, 0x22, 0x33))
_WHOLE = np.uint64(1 << 32)  # sets the hashes of sequences apart from those of windows
KINDS = {int(NUM): "num", int(NAME): "name", int(UNIT): "unit"}

_b = np.arange(256)
_DIGIT = (_b >= 48) & (_b < 58)
_LETTER = ((_b >= 65) & (_b < 91)) | ((_b >= 97) & (_b < 123)) | (_b >= 128)
_UPPER = (_b >= 65) & (_b < 91)
_STOP = np.isin(_b, [ord(c) for c in ".!?:;"])


class Template:
    """Template tokens of a text column: hash, row, and the bytes that each stands for."""

    def __init__(self, column: pa.Array):
        words = Words(column)
        buf, n = words.buf, len(words.buf)
        low = buf + (_UPPER[buf] * np.uint8(32))
        after = np.zeros(n, bool)
        after[1:] = buf[:-1] == 0xC3
        big = after & (buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97)  # À to Þ
        low = low + big * np.uint8(32)
        ink = _DIGIT[buf] | _LETTER[buf]
        at = np.arange(n)
        following = np.minimum.accumulate(np.where(ink, at, n)[::-1])[::-1] if n else at
        previous = np.maximum.accumulate(np.where(ink, at, -1)) if n else at
        start, end = following[words.start], previous[words.end - 1] + 1
        fine = start < words.end
        count = lambda mask: np.concatenate([[0], np.cumsum(mask)])
        newline, digits, letters = count(buf == 10), count(_DIGIT[buf]), count(_LETTER[buf])
        begins = np.ones(len(words.start), bool)  # a sentence, a line or the text
        if len(begins) > 1:
            begins[1:] = _STOP[buf[words.end[:-1] - 1]] | (newline[words.start[1:]] > newline[words.end[:-1]]) | (words.doc[1:] != words.doc[:-1])
        start, end, begins, self.doc = start[fine], end[fine], begins[fine], words.doc[fine]
        with np.errstate(over="ignore"):
            p, q = powers(n + 1)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((low.astype(np.uint64) + np.uint64(1)) * p[:-1], out=total[1:])
            h = mix((total[end] - total[start]) * q[start] + (end - start).astype(np.uint64))
        number = _DIGIT[buf[start]] & (digits[end] - digits[start] >= letters[end] - letters[start])
        capital = _UPPER[buf[start]] | ((buf[start] == 0xC3) & big[np.minimum(start + 1, max(n - 1, 0))])
        name = capital & ~begins & ~number
        unit = np.zeros(len(h), bool)
        if len(h) > 1:
            unit[1:] = np.isin(h[1:], word_hashes(UNITS)) & number[:-1] & (self.doc[1:] == self.doc[:-1])
        self.literal = ~(number | name | unit)
        self.hash = np.where(number, NUM, np.where(unit, UNIT, np.where(name, NAME, h)))
        self.low, self.start, self.end, self.plain = low, start, end, h
        self.first = np.searchsorted(self.doc, np.arange(words.n_docs + 1))
        self._total: np.ndarray | None = None

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(token, hash) of the windows within one text that are words for half at least."""
        k = len(self.hash) - width + 1
        if k <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        words = np.concatenate([[0], np.cumsum(self.literal)])
        at = np.flatnonzero((self.doc[:k] == self.doc[width - 1 :]) & (2 * (words[width:] - words[:-width]) >= width))
        return at, ngrams(self.hash, width)[at]

    def sequences(self, n: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(token, hash) of the n tokens as they stand, values included, from each token (of at, if given) within one text."""
        k = len(self.plain) - n + 1
        if k <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.arange(k) if at is None else at[at < k]
        at = at[self.doc[at] == self.doc[at + n - 1]]
        with np.errstate(over="ignore"):
            p, q = powers(len(self.plain) + 1)
            if self._total is None:
                self._total = np.zeros(len(self.plain) + 1, np.uint64)
                np.cumsum(self.plain * p[:-1], out=self._total[1:])
            return at, mix((self._total[at + n] - self._total[at]) * q[at] + np.uint64(n) + _WHOLE)

    def slots(self, at: int, width: int) -> list[tuple[str, str]]:
        return [(KINDS[int(self.hash[i])], self.low[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")) for i in range(at,
            at + width) if not self.literal[i]]


_hashes: dict[str, np.ndarray] = {}


def word_hashes(words: list[str]) -> np.ndarray:
    """Hashes of lower-case words, as Template has them."""
    name = words[0]
    if name not in _hashes:
        with np.errstate(over="ignore"):
            out = []
            for w in words:
                b = np.frombuffer(w.encode(), np.uint8).astype(np.uint64)
                out.append(mix(np.array([((b + np.uint64(1)) * powers(len(b))[0]).sum(dtype=np.uint64) + np.uint64(len(b))])))
        _hashes[name] = np.concatenate(out)
    return _hashes[name]


_WINDOWS = "id long, th long, h long, at int, windows int, nouns boolean, slots array<struct<kind:string,value:string>>"


def _emit(template: Template, ids: pa.Array, th: pa.Array, at: np.ndarray, h: np.ndarray, width: int, total: np.ndarray | None) -> pa.RecordBatch:
    doc = template.doc[at]
    tells = np.isin(template.plain, word_hashes(NOUN_WORDS)) if total is not None else np.zeros(0, np.int64)  # asked of items alone
    nouns = np.bincount(template.doc[tells], minlength=len(ids)) >= LEAST_NOUN_WORDS
    slots = [[{"kind": k, "value": v} for k, v in template.slots(i, width)] for i in at.tolist()]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))
    return pa.RecordBatch.from_pydict({
        "id": ids.take(pa.array(doc)), "th": th.take(pa.array(doc)), "h": pa.array(h.view(np.int64)), "at": pa.array((at - template.first[doc]).astype(np.int32)),
        "windows": pa.array(total[doc].astype(np.int32) if total is not None else np.zeros(len(at), np.int32)), "nouns": pa.array(nouns[doc]), "slots": pa.array(slots, kind),
    })


def item_windows(items: DataFrame) -> DataFrame:
    """The windows of benchmark items (id, text): each with how many its item has."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                t = Template(part.column("text"))
                at, h = t.windows(WIDTH)
                yield _emit(t, part.column("id"), part.column("th"), at, h, WIDTH, np.bincount(t.doc[at], minlength=part.num_rows))

    return items.mapInArrow(run, _WINDOWS)


_SEQUENCES = "id long, n int, first long, h long, windows int"


def item_sequences(items: DataFrame) -> DataFrame:
    """The items (id, text) with fewer than SURE windows: tokens, hash of the first WIDTH at most and of all, windows."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                t = Template(part.column("text"))
                n, windows = np.diff(t.first), np.bincount(t.doc[t.windows(WIDTH)[0]], minlength=part.num_rows)
                rows = np.flatnonzero((n > 0) & (windows < SURE))
                key = lambda row, n: int(t.sequences(n, t.first[row : row + 1])[1].view(np.int64)[0])
                yield pa.RecordBatch.from_pydict({
                    "id": part.column("id").take(pa.array(rows)), "n": pa.array(n[rows].astype(np.int32)),
                        "first": pa.array([key(r, min(int(n[r]), WIDTH)) for r in rows], pa.int64()),
                    "h": pa.array([key(r, int(n[r])) for r in rows], pa.int64()), "windows": pa.array(windows[rows].astype(np.int32)),
                })

    return items.mapInArrow(run, _SEQUENCES)


def _whole(t: Template, lengths: list[int], flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash), each once, of the sequences that may be items: the first WIDTH tokens are tested, then all."""
    may = lambda at, h: contains(flags, (h >> np.uint64(64 - BITS)).astype(np.int64))
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for width in sorted({min(n, WIDTH) for n in lengths}):
        at, h = t.sequences(width)
        begins = at[may(at, h)]
        for n in lengths if len(begins) else []:
            if min(n, WIDTH) == width:
                at, h = t.sequences(n, begins)
                hit = may(at, h)
                rows.append(t.doc[at[hit]])
                keys.append(h[hit])
    rows, keys = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
    return rows[new], keys[new]


def judge(matches: list[tuple[int, int, list[tuple[str, str, str]]]], windows: int, nouns: bool = False) -> tuple[int, int] | None:
    """(windows, changed values) of a document's best occurrence of an item, None if it has none. nouns: the item's nouns have capitals.

    matches has (token of the item, token of the document, pairs of kind, item's and document's value) for each window
    that they share. An occurrence is read from an alignment outwards: matches join it by how far they are shifted
    against it (by words put in or left out, an item's length at most), each window of either text once. All matches
    together are a reading too, for an item whose parts lie apart.
    """

    def verdict(tokens: set, pairs: set) -> tuple[int, int] | None:
        values = {p[:2] for p in pairs}
        if len(tokens) < COVER * windows or len(values) < CONSISTENT * len(pairs):
            return None
        names = [value == own for kind, value, own in pairs if kind == "name"]
        if nouns and sum(names) < SAME_NOUNS * len(names):
            return None
        return len(tokens), -sum(value != own for _, value, own in pairs)

    best = verdict({m[0] for m in matches}, {p for m in matches for p in m[2]})
    if best is None:
        tokens = [m[0] for m in matches]
        reach = max(tokens) - min(tokens) + WIDTH
        by_shift = sorted(((m[1] - m[0], *m) for m in matches), key=lambda m: m[:3])
        shifts = [m[0] for m in by_shift]
        for shift in sorted(set(shifts)):
            near = by_shift[bisect_left(shifts, shift - reach) : bisect_right(shifts, shift + reach)]
            own, places, pairs = set(), set(), set()
            for _, at, place, more in sorted(near, key=lambda m: abs(m[0] - shift)):
                if at not in own and place not in places:
                    own.add(at)
                    places.add(place)
                    pairs.update(more)
                    best = max(filter(None, (best, verdict(own, pairs))), default=None)
    return best and (best[0], -best[1])


_LEAKS = "doc_id long, item_id long, th long, n_windows long, item_windows long, n_changed long, item_tokens long"


def _judged(batches):
    """Rows of _LEAKS for rows (doc_id, item_id, th, windows, nouns, n, matches) with an occurrence."""
    schema = pa.schema([(field.split()[0], pa.int64()) for field in _LEAKS.split(", ")])
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            matches = [(m["at"], m["place"], [(p["kind"], p["value"], p["own"]) for p in m["pairs"]]) for m in row["matches"] if m["at"] >= 0]
            found = judge(matches, row["windows"], row["nouns"]) if matches else None
            if found is None and len(matches) < len(row["matches"]):  # the item as it stands
                found = len({m[0] for m in matches}), 0
            if found:
                out.append((row["doc_id"], row["item_id"], row["th"], found[0], row["windows"], found[1], row["n"]))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * len(schema))], schema=schema)


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, th, n_windows, item_windows, n_changed, item_tokens) for documents that hold a benchmark item.

    docs has doc_id and text, items item_id and text. n_windows of the item's item_windows windows are in the
    document's best occurrence (COVER of them at least, or any number if the document holds the item as it stands),
    n_changed counts slot values that differ there; th is xxhash64 of the text. item_tokens is known for items that are
    also looked for as they stand.

    Null and empty texts hold nothing and match nothing, as do items without a letter or digit. A window needs words
    (no placeholders) for half of its tokens at least; an item without such a window, as any with fewer than WIDTH
    tokens, is found as it stands (but for case and outer punctuation), not with other values. Rows with a null id are reported with it. Rows that repeat a doc_id and text are one.
    Ties and repeated items are reported each under its own item_id. Other columns are ignored. The benchmark
    may be of any size: a fixed table of bits thins the documents' windows, and a hash join decides.
    """
    small_batches(docs.sparkSession)
    items = items.select(F.col("item_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0).cast("long").alias("th"))
    wanted = keep(item_windows(items), "items")
    whole = keep(item_sequences(items), "whole-items")
    lengths = sorted(row.n for row in whole.select("n").distinct().collect())
    keys = wanted.select("h").unionByName(whole.select("h")).unionByName(whole.select(F.col("first").alias("h")))
    flags = share(docs.sparkSession, bit_table(keys.select(F.shiftrightunsigned("h", 64 - BITS).alias("slot"))))

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                t = Template(part.column("text"))
                at, h = t.windows(WIDTH)
                place = (h >> np.uint64(64 - BITS)).astype(np.int64)
                hit = contains(flags.value, place)
                if hit.any():
                    yield _emit(t, part.column("id"), part.column("th"), at[hit], h[hit], WIDTH, None)
                rows, h = _whole(t, lengths, flags.value)
                if len(rows):
                    found = _emit(t, part.column("id"), part.column("th"), t.first[rows], h, 0, None)
                    yield found.set_column(3, "at", pa.array(np.full(len(rows), -1, np.int32)))

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    found = keep(texts.mapInArrow(run, _WINDOWS), "found")
    release(flags)
    found = found.select(F.col("id").alias("doc_id"), "th", "h", F.col("at").alias("place"), F.col("slots").alias("own"))
    as_is = whole.select("id", "h", F.lit(-1).alias("at"), "windows", F.lit(False).alias("nouns"), F.array().cast(wanted.schema["slots"].dataType).alias("slots"), "n")
    item = wanted.select("id", "h", "at", "windows", "nouns", "slots", F.lit(None).cast("int").alias("n")).unionByName(as_is).withColumnRenamed("id", "item_id")
    pairs = F.zip_with("slots", "own", lambda a, b: F.struct(a["kind"].alias("kind"), a["value"].alias("value"), b["value"].alias("own")))
    met = found.join(item, "h").where(F.size("slots") == F.size("own")).select("doc_id", "th", "item_id", "windows", "nouns", "n",
        F.struct("at", "place", pairs.alias("pairs")).alias("match"))
    met = met.groupBy("doc_id", "item_id", "th").agg(F.max("windows").alias("windows"), F.max("nouns").alias("nouns"), F.max("n").alias("n"), F.collect_set("match").alias("matches"))
    enough = F.array_contains("matches.at", -1) | (F.size(F.array_distinct("matches.at")) >= COVER * F.col("windows"))
    return met.where(enough).mapInArrow(_judged, _LEAKS).select("doc_id", "item_id", "th", "n_windows", "item_windows", "n_changed", "item_tokens")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows whose text holds a benchmark item; all columns stay.

    An item of fewer than LEAST_TOKENS tokens removes nothing, as many clean texts have its words. Null and empty texts are kept, as is every row where the benchmark is empty. Repeated rows share their fate.
    """
    name = unused(docs.columns, "text_hash")
    long = F.coalesce(F.col("item_tokens") >= LEAST_TOKENS, F.lit(True))
    bad = keep(find_leaks(docs, items).where(long).select(F.col("th").alias(name)), "leaks")
    return without(docs.withColumn(name, F.xxhash64(F.coalesce("text", F.lit("")))), bad, name).drop(name)
