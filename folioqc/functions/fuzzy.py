"""Gestalt similarity and order-dependent matching inside a page."""

from __future__ import annotations

from collections import Counter, namedtuple
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioqc.functions import geometry as G
from folioqc.functions.text import normalise_strict, normalised
from folioqc.params import DEFAULT


class Blocks:
    """The matching blocks of other texts with one text, as difflib's SequenceMatcher has them, popular
    characters of long texts included; a text's places of a character are the bits of one number."""

    def __init__(self, text: str):
        self.text, places = text, {}
        for j, c in enumerate(text):
            places.setdefault(c, []).append(j)
        self.counts = {c: len(p) for c, p in places.items()}
        # Fixed values of difflib: in texts of 200 characters, those on more than a hundredth of the places start no block.
        most = len(text) // 100 + 1 if len(text) >= 200 else len(text)
        self.bits = {}
        for c, p in places.items():
            if len(p) <= most:
                bits = bytearray(len(text) // 8 + 1)
                for j in p:
                    bits[j >> 3] |= 1 << (j & 7)
                self.bits[c] = int.from_bytes(bits, "little")

    def shared(self, counts: dict[str, int]) -> int:
        """Characters that both have, each as often as the rarer side: no fewer than their blocks hold."""
        return sum(min(n, self.counts[c]) for c, n in counts.items() if c in self.counts)

    def _longest(self, other: str, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        """The longest block inside of the ranges, the first of equal ones in other, then in text."""
        b, bits, window = self.text, self.bits, (1 << bhi) - (1 << blo)
        i, j, size, runs = alo, blo, 0, []
        for row in range(alo, ahi):
            here = bits.get(other[row], 0) & window
            # In the k-th number are the places where a run of more than k characters ends.
            last, runs = runs, [here] if here else []
            if here:
                for ends in last:
                    ends = (ends << 1) & here
                    if not ends:
                        break
                    runs.append(ends)
                if len(runs) > size:
                    size = len(runs)
                    i, j = row - size + 1, (runs[-1] & -runs[-1]).bit_length() - size
        while i > alo and j > blo and other[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and other[i + size] == b[j + size]:
            size += 1
        return i, j, size

    def ratio(self, other: str) -> float:
        total, todo = 0, [(0, len(other), 0, len(self.text))]
        while todo:
            alo, ahi, blo, bhi = todo.pop()
            i, j, size = self._longest(other, alo, ahi, blo, bhi)
            if size:
                total += size
                if alo < i and blo < j:
                    todo.append((alo, i, blo, j))
                if i + size < ahi and j + size < bhi:
                    todo.append((i + size, ahi, j + size, bhi))
        length = len(other) + len(self.text)
        return 2.0 * total / length if length else 1.0


def ratio_of(reference: str, candidate: str) -> float:
    """Ratio of matching blocks; depends on the order of its arguments."""
    return Blocks(candidate).ratio(reference)


@F.pandas_udf(T.DoubleType())
def similarity(reference: pd.Series, candidate: pd.Series) -> pd.Series:
    return pd.Series([ratio_of(a or "", b or "") for a, b in zip(reference, candidate)])


class Ratios:
    """Ratios of references against fixed candidates. What a matcher learns about a candidate is
    learnt once, and a ratio is only worked out if its cheap upper bounds exceed what it must beat."""

    def __init__(self, candidates: list[str]):
        self.blocks = [Blocks(c) for c in candidates]
        self.reference, self.counts = None, {}

    def above(self, reference: str, k: int, least: float) -> float:
        """The ratio with candidate k if it is greater than least, else some number that is not."""
        b = self.blocks[k]
        length = len(reference) + len(b.text)
        if not length or 2.0 * min(len(reference), len(b.text)) / length <= least:
            return b.ratio(reference) if not length else least
        if reference != self.reference:
            self.reference, self.counts = reference, Counter(reference)
        return least if 2.0 * b.shared(self.counts) / length <= least else b.ratio(reference)


def bounded_pairs(reference: DataFrame, candidate: DataFrame, least: float) -> DataFrame:
    """job_id, page_index, ref_ord, cand_ord, a, b: the pairs of a page's texts whose ratio may reach
    least (above 0).

    A ratio is at most twice the characters that both have, each as often as the rarer side, over
    their lengths. So characters are an index: texts of a page meet by the characters they hold,
    and what they share is summed before any text is compared. Lengths that differ too much never
    meet.
    """
    keys = ["job_id", "page_index"]
    told = lambda d, o, t: d.select(*keys, F.col("ord").alias(o), normalised(F.col("text")).alias(t)).where(F.col(t) != "")
    a, b = told(reference, "ref_ord", "a"), told(candidate, "cand_ord", "b")

    def counted(d: DataFrame, o: str, t: str, n: str) -> DataFrame:
        letters = d.select(*keys, o, F.length(t).alias(f"{n}_all"), F.explode(F.split(t, "")).alias("letter"))
        return letters.groupBy(*keys, o, f"{n}_all", "letter").agg(F.count("*").alias(n))

    shares = counted(a, "ref_ord", "a", "m").join(counted(b, "cand_ord", "b", "n").hint("merge"), [*keys, "letter"])
    all_of = F.col("m_all") + F.col("n_all")
    near = shares.where(2 * F.least("m_all", "n_all") >= least * all_of)
    close = near.groupBy(*keys, "ref_ord", "cand_ord").agg(F.sum(F.least("m", "n")).alias("both"), F.first(all_of).alias("all")).where(2 * F.col("both") >= least * F.col("all"))
    return close.select(*keys, "ref_ord", "cand_ord").join(a.hint("merge"), [*keys, "ref_ord"]).join(b.hint("merge"), [*keys, "cand_ord"])


def scored_pairs(reference: DataFrame, candidate: DataFrame, least: float) -> DataFrame:
    """job_id, page_index, ref_ord, cand_ord, score of the pairs of a page whose ratio reaches least.
    Pairs, not pages, are dealt to tasks, so a long page is worked on by many."""
    pairs = bounded_pairs(reference, candidate, least).repartition("job_id", "page_index", "ref_ord", "cand_ord")
    return pairs.select("job_id", "page_index", "ref_ord", "cand_ord", similarity("a", "b").alias("score")).where(F.col("score") >= least)


def greedy_matches(reference: DataFrame, candidate: DataFrame, accept: float = DEFAULT.paragraph_match) -> DataFrame:
    """Each reference, in order, takes the unused candidate of highest ratio, if it reaches accept
    (above 0); others have a null candidate and score.

    Inputs: job_id, page_index, ord, text. Scores are worked out pair by pair in all tasks; only the
    choice, as it depends on those before it, is made page by page, over the few pairs that reach
    accept. A candidate whose ratio does not is never taken, so it is not looked at.
    """
    scores = scored_pairs(reference, candidate, accept)
    taken = greedy_by_score(scores, accept, ["job_id", "page_index"]).where("cand_ord is not null")
    taken = taken.select("job_id", F.col("page_index").cast("int").alias("page_index"), F.col("ref_ord").cast("int").alias("ref_ord"), F.col("cand_ord").cast("int").alias("cand_ord"), "score")
    every = reference.select(F.col("job_id").cast("long").alias("job_id"), F.col("page_index").cast("int").alias("page_index"), F.col("ord").cast("int").alias("ref_ord"))
    return every.join(taken.hint("merge"), ["job_id", "page_index", "ref_ord"], "left")


def greedy_by_score(scores: DataFrame, accept: float = DEFAULT.paragraph_match, keys: Sequence[str] = ("page",)) -> DataFrame:
    """page (or other keys), ref_ord, cand_ord, score: greedy matches over given scores (page, ref_ord, cand_ord,
    score); of scores that do not reach accept none is taken, and others whatever they are, 0 too.

    A page's scores pass in order as a stream, many pages in a batch: only the numbers of the
    candidates that the page at hand has used are held, and no page is a group of its own.
    """
    order = Window.partitionBy(*keys).orderBy("ref_ord", F.desc("score"), "cand_ord")
    names = [*keys, "ref_ord", "cand_ord", "score"]
    typed = scores.select(*(F.col(c).cast("bigint").alias(c) for c in names[:-1]), F.col("score").cast("double").alias("score"))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used: set[int] = set()
        at, last, kept = 0, None, None
        for batch in batches:
            *page, ref, cand, score, nth = (c.to_numpy() for c in batch.columns)
            if not len(nth):
                continue
            # A page's rows are numbered; one that is not the next breaks the choice.
            if (nth[0] != 1 and nth[0] != at + 1) or ((nth[1:] != 1) & (nth[1:] != nth[:-1] + 1)).any():
                raise ValueError("scores are not in order")
            at = nth[-1]
            fresh = np.concatenate([[nth[0] == 1 or ref[0] != last[-1]], (nth[1:] == 1) | (ref[1:] != ref[:-1])])
            # Number 0 is the reference that the batch before left open.
            which = np.cumsum(fresh)
            first = np.flatnonzero(fresh)
            found, gained = [-1] * (len(first) + 1), [0.0] * (len(first) + 1)
            if kept is not None:
                found[0], gained[0] = kept
            taken = [kept is not None] + [False] * len(first)
            turn = np.cumsum(nth == 1)
            good = np.flatnonzero(score >= accept)
            now = 0
            for k, j, v, w in zip(which[good].tolist(), cand[good].tolist(), score[good].tolist(), turn[good].tolist()):
                if w != now:
                    used, now = set(), w
                if not taken[k] and j not in used:
                    used.add(j)
                    found[k], gained[k], taken[k] = j, v, True
            if turn[-1] != now:
                used = set()
            heads = ([] if last is None else [last]) + list(zip(*(c[first].tolist() for c in (*page, ref))))
            shift = 0 if last is not None else 1
            last = heads[-1]
            kept = (found[-1], gained[-1]) if taken[-1] else None
            if len(heads) > 1:
                done = slice(shift, shift + len(heads) - 1)
                yield told(heads[:-1], found[done], gained[done], taken[done])
        if last is not None:
            yield told([last], *(([kept[0]], [kept[1]], [True]) if kept is not None else ([-1], [0.0], [False])))

    def told(heads: list, found: list, gained: list, taken: list) -> pa.RecordBatch:
        none = ~np.asarray(taken, bool)
        columns = *(pa.array(c, pa.int64()) for c in zip(*heads)), pa.array(found, pa.int64(), mask=none), pa.array(gained, pa.float64(), mask=none)
        return pa.RecordBatch.from_arrays(list(columns), names)

    return typed.withColumn("nth", F.row_number().over(order)).mapInArrow(match, ", ".join(f"{n} long" for n in names[:-1]) + ", score double")


def combined_score(text: Column, a: Column, b: Column) -> Column:
    """Text and position scores as one, with a bonus for boxes in the same cell of the page."""
    p = DEFAULT
    return text * p.text_weight + G.position_similarity(a, b) * p.position_weight + F.when(G.grid_cell(a) == G.grid_cell(b), p.same_cell_bonus).otherwise(0.0)


def nearest_by_score(scores: DataFrame) -> DataFrame:
    """page, ref_ord, text, position: the lexicographically greatest pair of scores of each reference,
    no less than (0, 0), of scores (page, ref_ord, text, position)."""
    best = F.max(F.struct("text", "position")).alias("m")
    found = scores.groupBy("page", "ref_ord").agg(best)
    least = F.greatest("m", F.struct(F.lit(0.0).alias("text"), F.lit(0.0).alias("position")))
    return found.select("page", "ref_ord", least.alias("m")).select("page", "ref_ord", "m.text", "m.position")


def _box(row) -> tuple[float, float, float, float]:
    return row.x0, row.y0, row.x1, row.y1


def _cell(b) -> tuple[int, int]:
    x, y = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
    return (x >= 0.33) + (x >= 0.66), (y >= 0.33) + (y >= 0.66)


def position_score(a, b) -> float:
    dx, dy = (a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2
    return max(0.0, 1.0 - (dx * dx + dy * dy) ** 0.5 / DEFAULT.position_scale)


def block_matches(left: list, right: list) -> list[tuple[int, int, float, float]]:
    """Greedy by text and position, without a threshold: (left, right, text, position)."""
    p, free, out = DEFAULT, list(range(len(right))), []
    texts = [normalise_strict(r.text) for r in right]
    boxes = [_box(r) for r in right]
    ratios = Ratios(texts)
    for i, item in enumerate(left):
        wanted, box = normalise_strict(item.text), _box(item)
        best = None
        for j in free if wanted else ():
            if not texts[j]:
                continue
            place = position_score(box, boxes[j])
            rest = place * p.position_weight + p.same_cell_bonus * (_cell(box) == _cell(boxes[j]))
            # A text score that cannot lift the sum above the best one is not worked out. The bound
            # leaves room for rounding.
            least = -1.0 if best is None else (best[0] - rest) / p.text_weight - 1e-9
            text = ratios.above(wanted, j, least)
            total = text * p.text_weight + place * p.position_weight + p.same_cell_bonus * (_cell(box) == _cell(boxes[j]))
            if text > least and (best is None or total > best[0]):
                best = (total, j, text, place)
        if best:
            free.remove(best[1])
            out.append((i, best[1], best[2], best[3]))
    return out


class Nearest:
    """The lexicographically greatest (text, position) similarity to any of some items, from (0, 0)."""

    def __init__(self, others: list):
        listed = [(t, _box(o)) for o in others if (t := normalise_strict(o.text))]
        self.boxes, self.ratios = [b for _, b in listed], Ratios([t for t, _ in listed])

    def __call__(self, item, enough: float = 2.0) -> tuple[float, float]:
        """Looks no further once a text score is enough."""
        wanted, box, best = normalise_strict(item.text), _box(item), (0.0, 0.0)
        for k, other in enumerate(self.boxes if wanted else ()):
            if best[0] >= enough:
                break
            # Just below the best, so that an equal text still competes by position.
            text = self.ratios.above(wanted, k, best[0] - 1e-12)
            if text >= best[0]:
                best = max(best, (text, position_score(box, other)))
        return best


def nearest(item, others: list) -> tuple[float, float]:
    return Nearest(others)(item)


def only_on_one_side(items: list, others: list, matched: set[int], most: int | None = None) -> list[int]:
    """Items without an equal partner left on the other side nor a similar one, in order, `most` at most."""
    stock: dict[str, int] = {}
    for o in others:
        t = normalise_strict(o.text)
        stock[t] = stock.get(t, 0) + 1
    out, near = [], None
    for i, item in enumerate(items):
        if most is not None and len(out) >= most:
            break
        t = normalise_strict(item.text)
        if not t:
            continue
        if stock.get(t, 0) > 0:
            stock[t] -= 1
        elif i not in matched:
            near = near or Nearest(others)
            text, place = near(item, DEFAULT.similar_text)
            if text < DEFAULT.similar_text and place < DEFAULT.similar_place:
                out.append(i)
    return out


Item = namedtuple("Item", ["y0", "x0", "ord", "text", "x1", "y1"])


def _items(listed: pa.ListArray) -> list[list[Item]]:
    """The items of each page."""
    every = list(map(Item._make, zip(*(c.to_pylist() for c in listed.flatten().flatten()))))
    ends = np.cumsum(listed.value_lengths().to_numpy(zero_copy_only=False)).tolist()
    return [every[a:b] for a, b in zip([0, *ends], ends)]


def page_discrepancies(a: list, b: list, most: int) -> list[tuple]:
    """(label, reference_text, candidate_text, text, position) of a page's items, in reading order."""
    rows: list[tuple] = []
    found = block_matches(a, b)
    for i, j, text, place in found:
        if normalise_strict(a[i].text) != normalise_strict(b[j].text) and (text >= DEFAULT.mismatch_text or place >= DEFAULT.mismatch_place):
            rows.append(("mismatch", a[i].text, b[j].text, text, place))
    # Work stops at the limit, phase by phase.
    rows = rows[:most]
    rows += [("candidate-only extra text item", "", b[j].text, 0.0, 0.0) for j in only_on_one_side(b, a, {m[1] for m in found}, most - len(rows))]
    rows += [("reference-only missing text item", a[i].text, "", 0.0, 0.0) for i in only_on_one_side(a, b, {m[0] for m in found}, most - len(rows))]
    return rows[:most]


def text_discrepancies(reference: DataFrame, candidate: DataFrame, most: int = 12) -> DataFrame:
    """Mismatched, candidate-only and reference-only text items of each page, at most `most`.

    Inputs: job_id, page_index, ord, text, x0, y0, x1, y1. Both sides must have items. A page is a
    row with its items of both sides; rows pass as a stream, many in a batch, and are dealt to as
    many tasks as a shuffle has, as they are few bytes for much work.
    """
    keys, names = ["job_id", "page_index"], ["job_id", "page_index", "ord", "label", "reference_text", "candidate_text", "text_score", "position_score"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.string()] * 3, *[pa.float64()] * 2]
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                job, page, left, right = whole.slice(at, 100).columns
                solid = lambda items: [r for r in items if r.text.strip()]
                rows = []
                for j, p, a, b in zip(job.to_pylist(), page.to_pylist(), map(solid, _items(left)), map(solid, _items(right))):
                    rows += [(j, p, n, *r) for n, r in enumerate(page_discrepancies(a, b, most) if a and b else ())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def listed(side: DataFrame, name: str) -> DataFrame:
        dealt = side.where("text is not null").repartition(int(side.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
        return dealt.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*Item._fields))).alias(name))

    pages = listed(reference, "left").join(listed(candidate, "right").hint("merge"), keys)
    found = pages.select(F.col("job_id").cast("long").alias("job_id"), F.col("page_index").cast("int").alias("page_index"), "left", "right").mapInArrow(
        compare, "job_id long, page_index int, ord int, label string, reference_text string, candidate_text string, text_score double, position_score double"
    )
    from folioqc.functions.text import mismatch_label

    return found.withColumn("label", F.when(F.col("label") == "mismatch", mismatch_label(F.col("reference_text"), F.col("candidate_text"), F.col("text_score"))).otherwise(F.col("label")))
