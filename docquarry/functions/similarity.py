"""String similarity by longest common subsequence, as columns."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry import fixed as V
from docquarry.functions.text import let

MAX_WORD = 62  # letters of a known word: its places are bits of one number


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _known(words: list[tuple[str, str]], threshold: float = 0.0) -> Column:
    """(places of every letter as bits, letters, what it stands for, where ``_partial_ratio`` must look) of known words, as one literal."""
    rows = []
    for word, name in words:
        if not 0 < len(word) <= MAX_WORD:
            raise ValueError(f"{word!r} has no letters or more than {MAX_WORD}")
        bits: dict[str, int] = {}
        for i, ch in enumerate(word):
            bits[ch] = bits.get(ch, 0) | (1 << i)
        letters = ", ".join(f"{_sql(ch)}, {b}L" for ch, b in bits.items())
        lost, pieces, ends = _may_hold(word, threshold)
        looked = ", ".join(f"named_struct('at', {at}, 'piece', {_sql(piece)}, 'look', {_sql(f'(?={_quoted(piece)})')})" for at, piece in pieces)
        rows.append(f"named_struct('bits', map({letters}), 'm', {len(word)}, 'name', {_sql(name)}, 'letters', {_sql(''.join(bits))}, 'lost', {lost}, "
                    f"'pieces', CAST(array({looked}) AS array<struct<at:int,piece:string,look:string>>), "
                    f"'ends', {_sql('|'.join(map(_quoted, ends)))})")
    return F.expr(f"array({', '.join(rows)})")


def _places(bits: Column, text: Column) -> Column:
    """For every letter of ``text`` its places in a known word, as bits."""
    return F.transform(F.split(text, ""), lambda ch: F.coalesce(F.element_at(bits, ch), F.lit(0).cast("long")))


def _common(places: Column, first: Column, size: Column) -> Column:
    """Length of the longest common subsequence of a text, by its ``places``, and ``size`` letters of the word
    from ``first`` on: one addition per letter, whose carries do the work of a table row."""
    shift = lambda name, x, by: F.call_function(name, x, by.cast("int"))

    def step(acc, m):
        hit = acc["s"].bitwiseAND(shift("shiftright", m, first))
        return F.struct((acc["s"] + hit).bitwiseOR(acc["s"] - hit).bitwiseAND(acc["full"]).alias("s"), acc["full"].alias("full"))

    full = shift("shiftleft", F.lit(1).cast("long"), size) - 1
    return size - F.aggregate(places, F.struct(full.alias("s"), full.alias("full")), step, lambda acc: F.bit_count(acc["s"]))


def _ratio(k: Column, text: Column) -> Column:
    return 200.0 * _common(_places(k["bits"], text), F.lit(0), k["m"]) / (F.length(text) + k["m"])


def ratio(word: str, text: Column) -> Column:
    """100 · 2·LCS / (sum of the lengths)."""
    return _ratio(_known([(word, "")])[0], text)


def _quoted(text: str) -> str:
    return "".join(ch if ch.isalnum() or ch == " " else "\\" + ch for ch in text)


def _pieces(word: str, n: int) -> list[tuple[int, str]]:
    """The word cut into ``n`` pieces, with their places; none if a piece would be empty."""
    cuts = [i * len(word) // n for i in range(n + 1)]
    return [(lo, word[lo:hi]) for lo, hi in zip(cuts, cuts[1:])] if n <= len(word) else []


def _may_hold(word: str, threshold: float) -> tuple[int, list[tuple[int, str]], list[str]]:
    """(d, pieces, pieces at the ends) without which no window can reach the threshold; no pieces: all may.

    A window as long as the word has all but ``d`` of the word's letters in order and ``d`` others. As 2 d changes leave one
    of 2 d + 1 pieces of the word alone, it has such a piece, at most ``d`` places from where the word has it. A shorter
    window of e letters over an end has at most (m + e) (1 - threshold / 100) changes, for which the same is true."""
    m = len(word)
    d = m - math.ceil(threshold * m / 100 - 1e-9)
    changes = math.floor((2 * m - 1) * (1 - threshold / 100) + 1e-9)
    return d, _pieces(word, 2 * d + 1), [piece for _, piece in _pieces(word, changes + 1)]


MAX_PLACES = 64  # of a piece in a text; where it is found more often, all windows are looked at


def _starts(k: Column, text: Column) -> Column:
    """First letters of the windows that have a piece of the word where it may be; null if there are too many."""
    def places(p):  # of a piece: sums of the lengths of what is between; overlapping ones count
        parts = F.transform(F.split(F.concat(F.lit("\0"), text), p["look"], -1), lambda x: F.length(x))
        step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["all"], F.array(acc["at"] + n)).alias("all"))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        found = let(parts, lambda x: F.when(F.size(x) <= MAX_PLACES, F.aggregate(F.slice(x, F.lit(1), F.size(x) - 1), none, step, lambda acc: acc["all"])))
        near = F.flatten(F.transform(found, lambda at: F.sequence(at - p["at"] - k["lost"], at - p["at"] + k["lost"])))
        return F.when(F.contains(text, p["piece"]), near).otherwise(F.array().cast("array<int>"))

    last = F.length(text) - k["m"] + 1
    strange = lambda i: F.length(F.call_function("translate", F.substr(text, i, k["m"]), k["letters"], F.lit("")))  # letters that the word has not
    return F.filter(F.array_distinct(F.flatten(F.transform(k["pieces"], places))), lambda i: F.when((i >= 1) & (i <= last), strange(i) <= k["lost"]).otherwise(False))


def _partial_ratio(k: Column, text: Column, threshold: float) -> Column:
    m, n = k["m"], F.length(text)
    score = lambda common, size: 200.0 * common / (size + m)
    best = lambda sizes, one: F.coalesce(F.array_max(F.transform(sizes, one)), F.lit(0.0))
    least = F.greatest(F.ceil(m * threshold / (200.0 - threshold) - 1e-9).cast("int"), F.lit(1))
    sizes = F.filter(F.sequence(F.lit(1), m), lambda e: (e >= least) & (e < m))  # of windows over an end
    zero = F.lit(0)

    def end(part, start):  # windows of the first or last m - 1 letters that begin or end with the text
        return F.when(F.regexp_like(part, k["ends"]), let(_places(k["bits"], part), lambda p: best(
            sizes, lambda e: score(_common(F.slice(p, start(e), e), zero, m), e)))).otherwise(0.0)

    every = let(_places(k["bits"], text), lambda p: best(
        F.sequence(F.lit(1), n - m + 1), lambda i: score(_common(F.slice(p, i, m), zero, m), m)))
    some = lambda starts: best(starts, lambda i: score(_common(_places(k["bits"], F.substr(text, i, m)), zero, m), m))
    inside = F.when(F.size(k["pieces"]) == 0, every).when(F.exists(k["pieces"], lambda p: F.contains(text, p["piece"])), let(
        _starts(k, text), lambda s: F.when(s.isNull(), every).otherwise(some(s)))).otherwise(0.0)

    def one(p):  # windows of the word, which is longer
        def at(i):
            start = F.greatest(i, F.lit(1))
            size = F.least(i + n - 1, m) - start + 1
            return 200.0 * _common(p, start - 1, size) / (size + n)
        return best(F.sequence(2 - n, m), at)

    found = F.when(n == 0, 0.0).when(n < m, let(_places(k["bits"], text), one)).otherwise(F.greatest(
        end(F.left(text, m - 1), lambda e: F.lit(1)), end(F.right(text, m - 1), lambda e: m - e), inside))
    return let(found, lambda x: F.when(x >= threshold, x).otherwise(0.0))


def partial_ratio(word: str, text: Column, threshold: float = 0.0) -> Column:
    """Best ratio of the shorter of both with any window of the longer one;
    windows may hang over either end. Scores below ``threshold`` come back as 0.

    Of windows as long as the word only those are looked at that ``_may_hold`` allows; of those that hang
    over an end, only as many as are long enough, where that end has a piece of the word."""
    return let(_known([(word, "")], threshold)[0], lambda k: _partial_ratio(k, text, threshold))


def fuzzy_carrier(tokens: Column, aliases=V.CARRIER_ALIASES, threshold: float = V.FUZZY_THRESHOLD) -> Column:
    """Carrier whose alias is most similar to a whole token; of equals the
    earliest token, then the first alias. Null in, null out."""
    if not aliases:
        return F.lit(None).cast("string")

    def best(k, j):
        def one(w, i):
            # lengths too far apart cannot reach the threshold
            near = 200.0 * F.least(F.length(w), k["m"]) >= threshold * (F.length(w) + k["m"])
            return F.when(near, F.struct(_ratio(k, w).alias("score"), (-i).alias("early"), (-j).alias("order"), k["name"].alias("name")))
        return F.array_max(F.transform(tokens, one))

    found = F.array_max(F.transform(_known([(alias, name) for name, alias in aliases]), best))
    return let(found, lambda b: F.when(b["score"] >= threshold, b["name"]))


def fuzzy_lob(query: Column, lobs=V.LOB_KEYWORDS, threshold: float = V.FUZZY_THRESHOLD,
              min_keyword: int = V.FUZZY_MIN_KEYWORD) -> Column:
    """Line of business of the keyword found best inside the query; among equal
    scores the longer keyword wins, then the earlier one. Null in, null out."""
    words = [(kw, lob) for lob, kws in lobs for kw in kws if len(kw) >= min_keyword]
    if not words:
        return F.lit(None).cast("string")
    scored = let(query, lambda q: F.transform(_known(words, threshold), lambda k, j: F.struct(
        _partial_ratio(k, q, threshold).alias("score"), k["m"].alias("n"), (-j).alias("order"), k["name"].alias("lob"))))
    return F.when(query.isNotNull(), let(F.array_max(scored), lambda b: F.when(b["score"] >= threshold, b["lob"])))
