"""Operator 3: licence scan by Dice coefficient over word bigrams, in DataFrame functions only.

Units of a text are its lines and, where it has several, the whole text. A unit is normalised (lower case, what is neither letter
nor digit is a blank) and turned into its set of word bigrams (a unit of one word: that word). Dice = 2 * shared / (own + the
template's). A unit of size n can only reach the threshold t with templates of a size from n*t/(2-t) to n*(2-t)/t, so the
templates, kept in memory by size, are pruned by size before any set is compared, and units outside all bounds go before their
bigrams are made. Nothing is shuffled: each document is judged by its own row against a fixed list of templates.

scan() judges those units, and oracle() is the same in SQL. scan_windows() judges every window of the whole text's words, so line
breaks and neighbouring words hide no notice: a window has at most n*(2-t)/t bigrams for a template of n and begins and ends with a
bigram of the template (others at its ends only lower Dice). Texts that share none of a template's rarer bigrams, so many that a match
cannot miss them all, are left out before any window is made.

Cases: null and empty text, or one without letters and digits, match nothing (license null, dice 0.0, n_matches 0); ties go to
the licence, then the template, that comes first; repeated rows get the same answer; an empty table gives no row; other columns
pass through, those with the name of a result as `<name>_input`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, text_or_empty
from .license_templates import PARAGRAPHS, TEMPLATES

THRESHOLD = 0.8
MADE = ("license", "dice", "n_matches", "_lic_sets", "_lic_best", "_lic_grams", "_lic_mine")


def template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[^0-9a-z]+", " ", text.lower()).split()
    return sorted({" ".join(p) for p in zip(words, words[1:])} or set(words[:1]))


def words_of(unit: Column) -> Column:
    return F.filter(F.split(F.lower(unit), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bigrams_of(words: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))
    return F.when(F.size(words) >= 2, F.array_distinct(pairs)).otherwise(words)


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with license, dice (of the best unit) and n_matches (units that reach the threshold)."""
    listed = [(name, i, template_bigrams(text)) for i, (name, text) in enumerate(templates)]
    bound = (2 - threshold) / threshold
    least, most = min(len(b) for *_, b in listed) / bound, max(len(b) for *_, b in listed) * bound
    by_size: dict[int, list] = {}
    for name, i, grams in listed:
        by_size.setdefault(len(grams), []).append((name, i, grams))
    struct = "struct<dice:double,least:int,license:string>"

    def judged(unit: Column) -> Column:
        """Best (dice, -template, license) of a unit's bigram set, null below the threshold."""
        size = F.size(unit)
        found = []
        for k, group in sorted(by_size.items()):
            near = (size >= k / bound - 1e-9) & (size <= k * bound + 1e-9)
            for name, i, grams in group:
                shared = F.size(F.array_intersect(unit, F.array(*[F.lit(g) for g in grams])))
                dice = 2.0 * shared / (size + k)
                found.append(F.when(near & (dice >= threshold), F.struct(dice.alias("dice"), F.lit(-i).alias("least"), F.lit(name).alias("license"))).cast(struct))
        return F.greatest(*found)

    def units(text: Column) -> Column:
        lines = F.split(text, "\n")
        return F.when(F.size(lines) > 1, F.concat(lines, F.array(text))).otherwise(lines)

    # By words first: a unit of w words has w - 1 bigrams at most, and fewer distinct ones only if it repeats itself.
    sized = F.filter(F.transform(units(text_or_empty()), words_of), lambda w: F.size(w) >= max(1, int(least)))
    known = F.array(*[F.lit(g) for g in sorted({g for *_, b in listed for g in b})])
    sets = F.filter(F.transform(sized, bigrams_of), lambda b: (F.size(b) >= least - 1e-9) & (F.size(b) <= most + 1e-9) & F.arrays_overlap(b, known))
    best = F.filter(F.transform("_lic_sets", judged), lambda b: b.isNotNull())
    return (
        aside(docs, MADE).withColumn("_lic_sets", sets)
        .withColumn("_lic_best", F.when(F.size("_lic_sets") > 0, best).otherwise(F.array().cast(f"array<{struct}>")))
        .withColumns({"license": F.array_max("_lic_best")["license"], "dice": F.coalesce(F.array_max("_lic_best")["dice"], F.lit(0.0)), "n_matches": F.size("_lic_best").cast("long")})
        .drop("_lic_sets", "_lic_best")
    )


#: Words that many texts have; bigrams of them are the last to look for.
COMMON = set("a an and any as at be by for from in is it of on or such that the this to under which with you your".split())


def bind(value: Column, use) -> Column:
    """use(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def scan_windows(docs: DataFrame, templates: Sequence[tuple[str, str]] = (*TEMPLATES, *PARAGRAPHS), threshold: float = THRESHOLD) -> DataFrame:
    """The documents with license, dice (of the best window) and n_matches (templates that a window reaches the threshold with)."""
    listed = [(name, i, template_bigrams(text)) for i, (name, text) in enumerate(templates)]
    bound = (2 - threshold) / threshold
    uses: dict[str, int] = {}
    for *_, grams in listed:
        for g in grams:
            uses[g] = uses.get(g, 0) + 1
    rarity = lambda g: (sum(w in COMMON for w in g.split()), uses[g], g)
    needed = lambda grams: max(1, math.ceil(len(grams) / bound - 1e-9))
    # A match has `needed` of the template's bigrams at least, so one of any n - needed + 1 of them.
    rare = sorted({g for *_, grams in listed for g in sorted(grams, key=rarity)[: len(grams) - needed(grams) + 1]})
    literal = lambda grams: F.split(F.lit("|".join(grams)), r"\|")
    struct = "struct<dice:double,least:int,license:string>"
    grams_of, mine = F.col("_lic_grams"), F.col("_lic_mine")

    def best(name: str, i: int, grams: list[str]) -> Column:
        k, need, longest = len(grams), needed(grams), int(len(grams) * bound + 1e-9)

        def window(at: Column, a: Column, b: Column, shared: Column) -> Column:
            own = F.array_distinct(F.slice(grams_of, F.get(at, a) + 1, F.get(at, b) - F.get(at, a) + 1))
            return bind(own, lambda u: 2.0 * F.size(F.array_intersect(u, shared)) / (F.size(u) + k))

        def windows(at: Column, shared: Column) -> Column:
            """Dice of the best window; at: places of the template's bigrams."""
            last = F.size(at) - 1
            ends = lambda a: F.filter(F.sequence(a + (need - 1), F.least(last, a + (longest - 1))), lambda b: F.get(at, b) - F.get(at, a) < longest)
            of_start = lambda a: F.array_max(F.transform(ends(a), lambda b: window(at, a, b, shared)))
            return F.when(F.size(at) >= need, F.array_max(F.transform(F.sequence(F.lit(0), F.size(at) - need), of_start)))

        def judged(shared: Column) -> Column:
            places = F.filter(F.sequence(F.lit(0), F.size(grams_of) - 1), lambda p: F.array_contains(shared, F.get(grams_of, p)))
            return F.when(F.size(shared) >= need, bind(places, lambda at: windows(at, shared)))

        dice = bind(F.array_intersect(literal(grams), mine), judged)
        return bind(dice, lambda d: F.when(d >= threshold, F.struct(d.alias("dice"), F.lit(-i).alias("least"), F.lit(name).alias("license"))).cast(struct))

    known = sorted(uses)
    words = words_of(text_or_empty())
    pairs = bind(words, lambda w: F.when(F.size(w) >= 2, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))).otherwise(w))
    found = F.filter(F.array(*[best(*x) for x in listed]), lambda b: b.isNotNull())
    none = F.array().cast(f"array<{struct}>")
    return (
        aside(docs, MADE).withColumn("_lic_grams", pairs)
        .withColumn("_lic_mine", F.when(F.arrays_overlap("_lic_grams", literal(rare)), F.array_intersect(grams_of, literal(known))).otherwise(F.array().cast("array<string>")))
        .withColumn("_lic_best", F.when(F.size("_lic_mine") > 0, found).otherwise(none))
        .withColumns({"license": F.array_max("_lic_best")["license"], "dice": F.coalesce(F.array_max("_lic_best")["dice"], F.lit(0.0)), "n_matches": F.size("_lic_best").cast("long")})
        .drop("_lic_grams", "_lic_mine", "_lic_best")
    )


def oracle(templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same in DuckDB's SQL."""
    values = ", ".join(f"({i}, '{name}', [{', '.join(repr(g) for g in template_bigrams(text))}])" for i, (name, text) in enumerate(templates))
    return rf"""
WITH t(i, license, grams) AS (VALUES {values}),
u0 AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, coalesce(text, '') AS text FROM documents),
u1 AS (SELECT doc_id, unnest(CASE WHEN len(lines) > 1 THEN list_append(lines, text) ELSE lines END) AS unit FROM u0),
u2 AS (SELECT doc_id, row_number() OVER () AS u, list_filter(regexp_split_to_array(lower(unit), '[^\p{{L}}\p{{N}}]+'), lambda w : w <> '') AS words FROM u1),
u3 AS (SELECT doc_id, u, CASE WHEN len(words) >= 2 THEN list_distinct(list_transform(range(1, len(words)), lambda k : words[k] || ' ' || words[k + 1])) ELSE words END AS grams FROM u2),
m AS (SELECT doc_id, u, i, license, 2.0 * len(list_intersect(u3.grams, t.grams)) / (len(u3.grams) + len(t.grams)) AS dice
      FROM u3 JOIN t ON len(u3.grams) > 0 AND list_has_any(u3.grams, t.grams)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, i) AS r, count(DISTINCT u) OVER (PARTITION BY doc_id) AS n FROM m WHERE dice >= {threshold})
SELECT d.doc_id, k.license, coalesce(k.dice, 0.0)::DOUBLE AS dice, coalesce(k.n, 0)::BIGINT AS n_matches
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id AND k.r = 1
"""
