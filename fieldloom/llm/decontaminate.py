"""Benchmark decontamination: windows over text whose numbers, names and units are typed placeholders, or that differ in case only."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm._shared import dealt_by, materialize, partitions, ship_package, sorted_groups, text_of

WINDOW = 8
#: Aligned windows that make a match: 13 tokens on end, or all windows of a shorter item.
ENOUGH = 6
#: Places by which an alignment may shift from one window to the next, by words put in or left out.
DRIFT = 8
#: An item of fewer tokens is not searched for; a window needs so many that are no placeholder.
LEAST_TOKENS, LEAST_WORDS = 4, 3
#: Up to so many windows of the benchmark, documents' windows are looked up before they are joined.
LOOKED_UP = 2_000_000
#: Rows that a worker holds before it passes them on.
AT_ONCE = 4096
#: The letter before a slot value that is a name.
NAME = "a"
#: Begins the template of a window that is compared as it stands, but for case.
LITERAL = "= "
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml cl l liter liters litre litres gallon gallons cup cups "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "dollar dollars euro euros cent cents percent degree degrees".split()
)
_TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?\n]+|[$€£%]")
_ENDS = frozenset(".!?\n")
_SIGNS = frozenset("$€£%")


def folded(text: str) -> tuple[list[str], list[str], list[int], list[int]]:
    """(tokens, raw, inside, initial): lower-cased words with <num> and <unit> in place of their kinds; raw has what stood there, lower-cased.

    A unit is a unit word or sign next to a number. inside and initial are the places of the capitalised words within
    and at the beginning of sentences.
    """
    out, raw, inside, initial, first, after_number = [], [], [], [], True, False
    for t in _TOKEN.findall(text):
        c = t[0]
        if c in _ENDS:
            first, after_number = True, False
            continue
        low = t.lower()
        if c.isdigit():
            out.append("<num>")
            after_number = True
        elif c in _SIGNS or after_number and low in UNITS:
            out.append("<unit>")
            after_number = False
        else:
            if low != t:
                (initial if first else inside).append(len(raw))
            out.append(low)
            after_number = False
        raw.append(low)
        first = False
    return out, raw, inside, initial


def _names(raw: list[str], inside: list[int], initial: list[int]) -> set[int]:
    """Places of names: capitalised words within a sentence, and at its beginning where the nearest other place of the word within a sentence has it so."""
    names = set(inside)
    known = {raw[k] for k in inside}
    doubtful = [k for k in initial if raw[k] in known]
    if doubtful:
        begun, wanted, places = set(initial), {raw[k] for k in doubtful}, {}
        for k, w in enumerate(raw):
            if w in wanted and k not in begun:
                places.setdefault(w, []).append(k)
        for k in doubtful:
            at = places[raw[k]]
            j = bisect_left(at, k)
            names |= {k} if min(at[max(0, j - 1) : j + 1], key=lambda x: abs(x - k)) in names else set()
    return names


def canonical(tokens: list[str], raw: list[str], inside: list[int], initial: list[int]) -> tuple[list[str], list[str], list[int]]:
    """(tokens, raw, at) of folded text with <name> in place of each run of names; at has where each token stands in the folded text."""
    names, begun = _names(raw, inside, initial), set(initial)
    out, values, at = [], [], []
    for k, t in enumerate(tokens):
        if k not in names:
            out.append(t)
            values.append(raw[k])
            at.append(k)
        elif k - 1 in names and k not in begun:
            values[-1] += " " + raw[k]
        else:
            out.append("<name>")
            values.append(raw[k])
            at.append(k)
    return out, values, at


def _window(tokens: list[str], raw: list[str], k: int, width: int) -> tuple[str, list[str]] | None:
    """(template, slot values, each after a letter of its kind) of a window with enough words."""
    part = tokens[k : k + width]
    slots = [t[2] + raw[k + i] for i, t in enumerate(part) if t[0] == "<"]
    if width - len(slots) < min(LEAST_WORDS, width - 1):
        return None
    return " ".join(part), slots


def _literal(raw: list[str], k: int, width: int) -> tuple[str, list[str]]:
    return LITERAL + " ".join(raw[k : k + width]), []


def item_windows(text: str) -> list[tuple[int, str, list[str], bool, int]]:
    """(position, template, slots, typed, width): windows with names typed, the same with names as words, or else literal ones."""
    tokens, raw, inside, initial = folded(text)
    if len(raw) < LEAST_TOKENS:
        return []
    out, seen = [], set()
    typed, values, at = canonical(tokens, raw, inside, initial)
    for part, held, where, names in ((typed, values, at, True), (tokens, raw, range(len(raw)), False)):
        width = min(WINDOW, len(part))
        for k in range(len(part) - width + 1) if width >= LEAST_TOKENS else ():
            w = _window(part, held, k, width)
            if w is not None and (where[k], w[0]) not in seen:
                seen.add((where[k], w[0]))
                out.append((where[k], *w, names, width))
    if not out:
        width = min(WINDOW, len(raw))
        out = [(k, *_literal(raw, k, width), False, width) for k in range(len(raw) - width + 1)]
    return out


_ITEM = "item_id long, item_part long, item_pos int, template string, item_slots array<string>, typed boolean, width int, n_windows int, n_typed int"
_DOC = "doc_id long, doc_part long, doc_pos int, template string, doc_slots array<string>"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "boolean": pa.bool_()}


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], list(names))


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        rows = []
        for i, part, text in zip(*(c.to_pylist() for c in rb.columns)):
            found = item_windows(text)
            n, n_typed = len({w[0] for w in found}), len({w[0] for w in found if w[3]})
            rows += [(i, part, *w, n, n_typed) for w in found]
        yield _arrow(rows, _ITEM)


def _doc_windows(widths: list[int], known: frozenset[str] | None, literal: bool):
    """Document windows; with known, only those of known templates, found from runs of words that known templates hold.

    Each window is given with names as words and, if it holds any, with names typed; with literal, as it stands too.
    """
    words = exact = None
    if known is not None:
        words = {w for t in known if not t.startswith(LITERAL) for w in t.split(" ")}
        exact = {w for t in known if t.startswith(LITERAL) for w in t[len(LITERAL) :].split(" ")}

    def starts(tokens: list[str], width: int, vocabulary: set[str] | None) -> list[int]:
        if len(tokens) < width:
            return []
        if vocabulary is None:
            return list(range(len(tokens) - width + 1))
        seen = np.cumsum(np.fromiter(map(vocabulary.__contains__, tokens), np.int32, len(tokens)))
        return np.flatnonzero(seen[width - 1 :] - np.concatenate([[0], seen[:-width]]) == width).tolist()

    def of(text: str) -> Iterator[tuple[int, str, list[str]]]:
        tokens, raw, inside, initial = folded(text)
        streams = [(tokens, raw, range(len(raw)))]
        if inside:
            streams.append(canonical(tokens, raw, inside, initial))
        for width in widths:
            for n, (part, held, at) in enumerate(streams):
                for k in starts(part, width, words):
                    w = _window(part, held, k, width)
                    if w is not None and (known is None or w[0] in known) and (n == 0 or "<name>" in w[0]):
                        yield at[k], *w
            if literal:
                for k in starts(raw, width, exact):
                    w = _literal(raw, k, width)
                    if known is None or w[0] in known:
                        yield k, *w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for rb in batches:
            for i, part, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), rb.column(2)):
                for w in of(text.as_py()):
                    rows.append((i, part, *w))
                    if len(rows) == AT_ONCE:
                        yield _arrow(rows, _DOC)
                        rows = []
        if rows:
            yield _arrow(rows, _DOC)

    return run


def chains(hits: Iterable[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Alignments of (place in the item, place in the document): both places rise, and the shift between them changes by DRIFT at most a step.

    The longest come first; each hit is in one.
    """
    best: dict[tuple[int, int], tuple[int, tuple[int, int] | None]] = {}
    last: dict[int, tuple[int, int]] = {}
    hits = sorted(hits, key=lambda h: (h[1], -h[0]))
    for p, q in hits:
        length, before = 0, None
        for step in range(-DRIFT, DRIFT + 1):
            g = last.get(q - p + step)
            if g is not None and g[0] < p and g[1] < q and (best[g][0], -abs(step)) > (length, -abs(before[1] - before[0] - q + p) if before else 0):
                length, before = best[g][0], g
        best[p, q] = length + 1, before
        last[q - p] = p, q
    used = set()
    for h in sorted(hits, key=lambda h: -best[h][0]):
        chain = []
        while h is not None and h not in used:
            used.add(h)
            chain.append(h)
            h = best[h][1]
        if chain:
            yield chain[::-1]


def _agree(slots: list[set[tuple[str, str]]]) -> tuple[list[int], set[tuple[str, str]]]:
    """(indices of windows, pairs of slot values) where each value of the item stands for one in the document.

    For each value of the item, those that stand in most windows first, the value of the document with most of the
    windows left is taken and windows with another are put aside. Different values of the item may get the same one,
    but a name of the item that keeps its place may not take another name's place as well: then nothing agrees.
    """
    left = set(range(len(slots)))
    where: dict[str, dict[str, set[int]]] = {}
    for k, pairs in enumerate(slots):
        for a, b in pairs:
            where.setdefault(a, {}).setdefault(b, set()).add(k)
    for _, had in sorted(where.items(), key=lambda x: (-len(set().union(*x[1].values())), x[0])):
        if len(had) > 1:
            taken = max(had, key=lambda b: (len(had[b] & left), b))
            left -= set().union(*(ks for b, ks in had.items() if b != taken))
    kept = sorted(left)
    pairs = set().union(*(slots[k] for k in kept))
    if any(a != b and a[0] == NAME and (b, b) in pairs for a, b in pairs):
        return [], set()
    return kept, pairs


_KEYS = ("doc_id", "item_id", "doc_part", "item_part")
_MATCH = "doc_id long, item_id long, n int, n_windows int, n_slots int, n_changed int"


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, g in sorted_groups(batches, *_KEYS):
        n_windows, n_typed = g.column("n_windows")[0].as_py(), g.column("n_typed")[0].as_py()
        if len(g) < min(x for x in (n_windows, n_typed, ENOUGH) if x):
            continue
        hits: dict[tuple[int, int], tuple[bool, set[tuple[str, str]]]] = {}
        for p, q, typed, a, b in zip(*(g.column(c).to_pylist() for c in ("item_pos", "doc_pos", "typed", "item_slots", "doc_slots"))):
            had = hits.get((p, q), (False, set()))
            hits[p, q] = had[0] or typed, had[1] | set(zip(a, b))
        rows = []
        for chain in chains(hits):
            kept, pairs = _agree([hits[h][1] for h in chain])
            n, typed = len(kept), sum(hits[chain[k]][0] for k in kept)
            if n and (n >= min(n_windows, ENOUGH) or n_typed and typed >= min(n_typed, ENOUGH)):
                rows.append((*key[:2], n, n_windows, len(pairs), sum(a != b for a, b in pairs)))
        if rows:
            yield _arrow([max(rows)], _MATCH)


def contaminated(docs: DataFrame, benchmark: DataFrame, looked_up: int = LOOKED_UP) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, n_slots, n_changed) of each document and item that match, whole texts.

    Windows of eight canonical tokens (of all tokens for items of 4 to 7) are joined on their template: with names typed,
    or with all words lower-cased, so that text in another case is found. An item without a window of enough words is
    searched for as it stands. An alignment may shift by up to eight places from a window to the next. Its windows match
    if there are six of them, or all the item has, whose slots are consistent: each value of the item stands for one value in the document; windows that
    differ from most are left out. n_changed counts the values that differ: 0 is a copy, more a re-parameterised question. The
    best alignment is reported.
    Null and empty texts, and items of under four tokens, match nothing; null ids match nothing; repeated documents,
    items and rows count once for each pair of ids; empty tables give no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), text_of().alias("text")).distinct()
    items = items.select("item_id", F.xxhash64("text").alias("item_part"), "text")
    items = materialize(items.mapInArrow(_item_windows, _ITEM), "items")
    n = items.count()
    known = frozenset(r[0] for r in items.select("template").distinct().collect()) if n <= looked_up else None
    literal = not items.where(F.col("template").startswith(LITERAL)).isEmpty()
    widths = sorted(r[0] for r in items.select("width").distinct().collect())  # WINDOW at most
    slim = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), text_of().alias("text")).select("doc_id", F.xxhash64("text").alias("doc_part"), "text")
    found = slim.mapInArrow(_doc_windows(widths, known, literal), _DOC)
    at = found.join(F.broadcast(items.drop("width")) if n <= 50_000 else items.drop("width"), "template")
    at = at.select(*_KEYS, "item_pos", "doc_pos", "typed", "item_slots", "doc_slots", "n_windows", "n_typed")
    each = dealt_by(at, partitions(spark), *_KEYS).mapInArrow(_matches, _MATCH)
    best = F.max(F.struct("n", "n_windows", "n_slots", "n_changed")).alias("b")
    out = each.groupBy("doc_id", "item_id").agg(best)
    return out.select("doc_id", "item_id", F.col("b.n").alias("n_windows"), F.col("b.n_windows").alias("item_windows"), "b.n_slots", "b.n_changed")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that match no item."""
    hit = materialize(contaminated(docs, benchmark).select("doc_id").distinct(), "contaminated")
    return docs.join(hit, "doc_id", "left_anti").select(*docs.columns)
