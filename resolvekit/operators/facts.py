"""What the rows of an entity say together: sets of its ids and of what points at them, of many entities at a time.

A row has the entity, what it tells (`code`: a kind, flags and a number), an id and a list of texts; few and short
columns, as each value of each row is written for Python. Rows come sorted by entity, so an entity's rows are read once, by one task; texts become numbers that order as they do, and sets
are sorted arrays of (entity, number).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Kinds of rows, and what of each stands in the columns id and more. `b` is a number within the code.
CLAIM = 0  # id: value, more: the authority that says it, the position's text; flags: provider, source
AUTHORITY = 1  # id, more: type, begin, homepages
PROFILE = 2  # id, more: name, its key, aliases
RETIRED = 3  # id; flags: provider, redirected, deprecated
CATALOG = 4  # id, more: titles; flag: it has releases
LOOKUP = 5  # id
STORED = 6  # id
AUDIT = 7  # id: least linked id, more: greatest linked id, b: competitors
ERROR = 8
BLOCKED = 9  # id: code
RELATION = 10  # more: ids
PAIR = 11  # flag: two catalogs share titles
#: Flags: a provider's or source's place here; others have the number after the last.
PROVIDERS, SOURCES = ("musicbrainz", "discogs", "wikidata", "spotify"), ("stored", "musicbrainz", "wikidata")
#: Places in a code: flags, a source among them, where a position's text is, whether b is null, whether numbers are too large for the code, the position's first number, b.
FLAG, SOURCE, TEXT, NULL, FAR, FIRST, NUMBER = 1 << 4, 1 << 7, 1 << 9, 1 << 11, 1 << 12, 1 << 13, 1 << 16
#: The position's text: second of more, the id, empty, null. Numbers that are too large follow it in more.
SECOND, SAME, EMPTY, NOTHING = range(4)
ROWS = "entity {}, code bigint, id string, more array<string>"
#: Rows that a task takes at once; more if an entity has more.
TAKEN = 1 << 17

NUMBERS = ("mb", "dg", "wd", "sp", "mb_records", "dg_records", "begins", "url_entities", "with_pages", "most_profiles", "agreeing", "errors", "active_others", "competitors")
FLAGS = ("mutual", "linked", "kinds", "same_begin", "joint", "linked_pages", "one_name", "every_name", "shared_name", "corroborated", "redirected", "deprecated", "anchored", "audited", "confirmed",
    "graph_asserts", "graph_says")
TEXTS = ("blocked", "linked_lo", "linked_hi")
FACTS = "entity {}, " + ", ".join([*(f"{c} bigint" for c in NUMBERS), *(f"{c} boolean" for c in FLAGS), *(f"{c} string" for c in TEXTS)]) + ", lost_ids array<string>, lost_records array<string>, own array<struct<id:string>>"


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of facts (FACTS) for each entity of rows (ROWS) that are sorted by it."""
    held, size, enough = [], 0, TAKEN
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= enough:
            rows, places, names = _entities(held)
            last = int(np.searchsorted(places, places[-1]))
            if last:
                yield _facts(rows.slice(0, last), places[:last], names.slice(0, int(places[-1])))
            rest = rows.slice(last)
            held, size = [rest], rest.num_rows
            enough = max(TAKEN, 2 * size)
    if size:
        yield _facts(*_entities(held))


def _entities(held: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray, pa.Array]:
    rows = pa.concat_batches(held) if len(held) > 1 else held[0]
    found = pc.dictionary_encode(rows.column("entity"), null_encoding="encode")
    return rows, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def _within(keys: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Which of keys are in the sorted pool."""
    if not len(pool):
        return np.zeros(len(keys), bool)
    return pool[np.minimum(np.searchsorted(pool, keys), len(pool) - 1)] == keys


def _numbers(texts: list[pa.Array]) -> tuple[list[np.ndarray], pa.Array]:
    """Texts as numbers from 1 on that order as they do, 0 for null, and the texts in order."""
    whole = pa.concat_arrays([x.cast(pa.large_string()) for x in texts])
    found = pc.dictionary_encode(whole)
    order = pc.sort_indices(found.dictionary).to_numpy()
    rank = np.zeros(len(order) + 1, np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    every = rank[pc.fill_null(found.indices, len(order)).to_numpy(zero_copy_only=False)]
    return np.split(every, np.cumsum([len(x) for x in texts])[:-1]), found.dictionary.take(pa.array(order))


def _lists(n: int, entity: np.ndarray, values: pa.Array) -> pa.Array:
    """A list for each of n entities, of values that are sorted by entity."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(entity, minlength=n))]), pa.int32()), values)


def _facts(rows: pa.RecordBatch, e: np.ndarray, names: pa.Array) -> pa.RecordBatch:
    n, code, more = len(names), rows.column("code").to_numpy(), rows.column("more")
    kind, provider, source = code % FLAG, code // FLAG % (SOURCE // FLAG), code // SOURCE % (TEXT // SOURCE)
    size = pc.fill_null(pc.list_value_length(more), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, row = np.cumsum(size) - size, np.repeat(np.arange(len(e)), size)
    nth, flat = np.arange(len(row)) - begin[row], pc.list_flatten(more)
    (id_, listed_), words = _numbers([rows.column("id"), flat])
    # the first two of most lists are columns
    x, c = (np.where(size > k, np.append(listed_, 0)[np.minimum(begin + k, len(listed_))], 0) for k in (0, 1))
    where = code // TEXT % (NULL // TEXT)
    none = pc.index(words, "").as_py() + 1  # the number of the empty text; 0 if there is none
    claim = kind == CLAIM
    c = np.where(claim & (where == SAME), id_, np.where(claim & (where == EMPTY), -1 if none == 0 else none, np.where(claim & (where == NOTHING), -2, c)))
    c = np.where(claim & (c <= 0), np.where(c == -1, 0, -1), c)  # null before empty
    low = np.iinfo(np.int64).min
    a, b = code // FIRST % (NUMBER // FIRST), np.where(code // NULL % 2 == 1, low, code // NUMBER)
    for i in np.flatnonzero(code // FAR % 2 == 1):
        a[i], b[i] = (low if v is None else int(v) for v in more[int(i)].as_py()[2:4])
    rest = (nth >= 2) | (kind[row] == CATALOG) | (kind[row] == RELATION)
    at, each, lists = row[rest], listed_[rest], flat.filter(pa.array(rest))
    U = len(words) + 1
    key, of = e * U + id_, [kind == k for k in range(PAIR + 1)]
    count = lambda keys: np.bincount(keys // U, minlength=n)
    any_ = lambda entities: np.bincount(entities, minlength=n) > 0
    claims = [of[CLAIM] & (provider == p) for p in range(4)]
    M, D, W, S = (np.unique(key[x]) for x in claims)
    mb, dg, wd, sp = map(count, (M, D, W, S))
    records, profiles = np.unique(key[of[AUTHORITY]]), np.unique(key[of[PROFILE]])
    retired = [np.unique(key[of[RETIRED] & (provider == p)]) for p in range(3)]
    known_mb, known_dg = _within(M, records), _within(D, profiles)

    def shared(entity, what, who):
        """(keys, groups): different (entity, what), and which of them different ones of who have."""
        keys, place = np.unique(entity * U + what, return_inverse=True)
        return keys, np.bincount(np.unique(place * U + who) // U, minlength=len(keys)) > 1

    def several(mask, column):
        """The number of different values that an entity has in a column."""
        return count(np.unique(e[mask] * U + column[mask]))

    def lead(mask):
        """(entities, rows): of an entity the row with the least position and id."""
        i = np.flatnonzero(mask)
        i = i[np.lexsort((id_[i], c[i], b[i], a[i], e[i]))]
        first = np.ones(len(i), bool)
        first[1:] = e[i[1:]] != e[i[:-1]]
        return e[i[first]], i[first]

    # begins, titles and pages that several have; null is a page like others, an id that is null has no begin or title
    begun = of[AUTHORITY] & (c > 0)
    begins = several(begun, c)
    with_id = begun & (id_ > 0)
    keys, many = shared(e[with_id], c[with_id], id_[with_id])
    same_begin = any_(keys[many] // U)
    empty = pc.equal(pc.binary_length(lists), 0).fill_null(True).to_numpy(zero_copy_only=False)
    i = of[CATALOG][at] & ~empty & (id_[at] > 0)
    keys, many = shared(e[at[i]], each[i], id_[at[i]])
    titles = count(keys[many])
    catalogs = count(np.unique(key[of[CATALOG]]))
    i = of[AUTHORITY][at] & _within(key[at], M)
    paged = np.unique(key[at[i]])
    keys, many = shared(e[at[i]], each[i], id_[at[i]])
    on_shared = np.unique(key[at[i]][_within(e[at[i]] * U + each[i], keys[many])])
    who, first = lead(claims[0])
    linked_pages = np.zeros(n, bool)
    linked_pages[who] = _within(key[first], on_shared)
    # profiles that name each other: links to known ones from known ones, and to claimed ones from claimed ones
    i = of[PROFILE][at] & (id_[at] > 0) & (each > 0) & (each != id_[at])
    links = np.unique(np.searchsorted(profiles, key[at[i]]) * U + each[i])
    start, end = profiles[links // U], profiles[links // U] // U * U + links % U
    end_known, end_claimed = _within(end, profiles), _within(end, D) & _within(start, D)
    in_known, in_claimed, found_all = count(start[end_known]), count(start[end_claimed]), count(profiles)
    # what an authority says of profiles and stored ids
    said = claims[1] & (x > 0) & (id_ > 0)
    by, place = np.unique(e[said] * U + x[said], return_inverse=True)
    told = np.bincount(np.unique(place * U + id_[said]) // U, minlength=len(by))
    most_profiles = np.zeros(n, np.int64)
    np.maximum.at(most_profiles, by // U, told)
    stored = np.unique(key[claims[3] & (source == 0)])
    said = np.flatnonzero(claims[3] & (x > 0) & (id_ > 0))
    said = said[_within(e[said] * U + x[said], M)]
    pairs = np.unique(np.searchsorted(M, e[said] * U + x[said]) * U + id_[said])
    target, times = np.unique(M[pairs // U] // U * U + pairs % U, return_counts=True)
    here = _within(target, stored)
    agreeing = np.zeros(n, np.int64)
    np.maximum.at(agreeing, target[here] // U, times[here])
    confirmed = any_(stored[_within(stored, np.unique(key[claims[3] & (source == 1)]))] // U)
    graph_asserts = any_(stored[_within(stored, np.unique(key[claims[3] & (source == 2)]))] // U)
    # names of claimed profiles
    mine = of[PROFILE] & _within(key, D)
    unnamed = any_(np.concatenate([D[~known_dg] // U, e[mine & (c == 0)]]))
    every_name = (dg > 0) & ~unnamed
    # graph entities that are still in use besides the first
    who, first = lead(claims[2])
    active_others = count(W[~_within(W, retired[2])])
    active_others[who] -= ~_within(key[first], retired[2])
    # relations that cover just the claimed profiles
    i = of[RELATION][at]
    ids = np.unique(at[i] * U + each[i])
    told = ids // U
    size = np.bincount(told, minlength=len(e))
    inside = np.bincount(told[_within(e[told] * U + ids % U, D)], minlength=len(e))
    corroborated = any_(e[of[RELATION] & (size == dg[e]) & (inside == size)])
    # the least or greatest text or number
    text = lambda codes: words.take(pa.array(np.maximum(codes - 1, 0), mask=codes <= 0)) if len(words) else pa.nulls(len(codes), words.type)

    def extreme(f, mask, values, none):
        out = np.full(n, none, np.int64)
        f.at(out, e[mask], values[mask])
        return out

    least = lambda mask, values: np.where((found := extreme(np.minimum, mask & (values > 0), values, U)) < U, found, 0)
    competitors = extreme(np.maximum, of[AUDIT], b, low)
    # ids without a record: those that aren't retired by provider's name, all of them authorities first
    lost = np.concatenate([D[~known_dg], M[~known_mb]])
    is_mb = np.repeat([False, True], [np.sum(~known_dg), np.sum(~known_mb)])
    gone = np.concatenate([_within(D[~known_dg], retired[1]), _within(M[~known_mb], retired[0])])

    def listed(order, keep, prefix, sep):
        i = order[keep[order]]
        provider = pa.array(np.array(PROVIDERS[1::-1], object)).take(pa.array(is_mb[i].astype(np.int64)))
        return _lists(n, lost[i] // U, pc.binary_join_element_wise(*(x.cast(pa.string()) for x in prefix(provider)), text(lost[i] % U).cast(pa.string()), sep))

    lost_ids = listed(np.lexsort((lost % U, is_mb, lost // U)), ~gone, lambda p: [p], ":")
    lost_records = listed(np.lexsort((lost % U, ~is_mb, lost // U)), np.ones(len(lost), bool),
        lambda p: [pc.binary_join_element_wise("missing_", p, "_record:", "")], "")
    own = np.flatnonzero(of[STORED])
    flag = lambda k, bit=1: any_(e[of[k] & (code // FLAG // bit % 2 == 1)])
    out = {
        "mb": mb, "dg": dg, "wd": wd, "sp": sp, "mb_records": count(M[known_mb]), "dg_records": count(D[known_dg]), "begins": begins, "url_entities": several(of[LOOKUP] & (id_ > 0), id_),
        "with_pages": count(paged), "most_profiles": most_profiles, "agreeing": np.where(count(stored) == 1, agreeing, 0), "errors": np.bincount(e[of[ERROR]], minlength=n), "active_others": active_others,
        "competitors": pa.array(competitors, pa.int64(), mask=competitors == low), "mutual": (found_all > 1) & (in_known == found_all * (found_all - 1)), "linked": (dg > 1) & (in_claimed == dg * (dg - 1)),
        "kinds": several(of[AUTHORITY] & (x > 0), x) > 1, "same_begin": same_begin, "joint": flag(PAIR) | ((catalogs <= 2) & (titles >= 2)), "linked_pages": linked_pages,
        "one_name": several(mine & (x > 0), x) == 1, "every_name": every_name, "shared_name": every_name & (several(mine & (c > 0), c) == 1), "corroborated": corroborated,
        "redirected": flag(RETIRED, 8), "deprecated": flag(RETIRED, 16), "anchored": flag(CATALOG), "audited": any_(e[of[AUDIT]]), "confirmed": confirmed, "graph_asserts": graph_asserts,
        "graph_says": any_(e[claims[2] & (source == 2)]), "blocked": text(least(of[BLOCKED], id_)), "linked_lo": text(least(of[AUDIT], id_)), "linked_hi": text(extreme(np.maximum, of[AUDIT], x, 0)),
        "lost_ids": lost_ids, "lost_records": lost_records, "own": _lists(n, e[own], pa.StructArray.from_arrays([text(id_[own]).cast(pa.string())], ["id"])),
    }
    kinds = {**dict.fromkeys(NUMBERS, pa.int64()), **dict.fromkeys(FLAGS, pa.bool_()), **dict.fromkeys(TEXTS, pa.string())}
    ready = {k: v.cast(kinds[k]) if k in TEXTS else v if isinstance(v, pa.Array) else pa.array(v, kinds[k]) for k, v in out.items()}
    order = [*NUMBERS, *FLAGS, *TEXTS, "lost_ids", "lost_records", "own"]
    return pa.RecordBatch.from_arrays([names, *(ready[k] for k in order)], ["entity", *order])
