"""Pension-operator entity resolution (C1-C3): exact, then fuzzy top-3."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nestegg import constants as K
from nestegg.functions.common import py_strip
from nestegg.session import bounded_broadcast


def _place(a: Column, b: Column, i: Column, k: Column) -> Column:
    """Where ``k`` characters of ``a`` from ``i`` on first stand in ``b``; 0 if nowhere."""
    return F.call_function("locate", F.substring(a, i, k), b)


def _longest_match(a: Column, b: Column) -> Column:
    """struct(k, i, j): the longest common substring (k characters from 1-based i of a and j of b).

    Of equally long ones that which starts first in a, then first in b. A start can only win with more
    characters than the best so far, and where k characters are found, fewer are too.
    """
    none = F.struct(F.lit(0).alias("k"), F.lit(0).alias("i"), F.lit(0).alias("j"))

    def longer(best, i):
        room = F.length(a) - i + 1
        found = F.filter(F.sequence(best["k"] + 1, F.greatest(room, best["k"] + 1)),
                         lambda k: (k <= room) & (_place(a, b, i, k) > 0))
        k = F.array_max(found)
        return F.when(k.isNull(), best).otherwise(F.struct(k.alias("k"), i.alias("i"), _place(a, b, i, k).alias("j")))

    return F.aggregate(F.sequence(F.lit(1), F.length(a)), none, longer)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def matched_characters(a: Column, b: Column) -> Column:
    """Characters in the matching blocks of two texts: the longest match, then the same left and right of it.

    The parts still to be looked at are a stack in a fold. Each match leaves two parts at most and takes a
    character of the shorter text, so 2 * length + 1 steps empty it.
    """
    part = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    both = lambda p: (p["a"] != "") & (p["b"] != "")
    start = F.struct(F.filter(F.array(part(a, b)), both).alias("todo"), F.lit(0).alias("n"))

    def step(state, _):
        def matched(top, rest):
            def split(m):
                left = part(F.substring(top["a"], F.lit(1), m["i"] - 1), F.substring(top["b"], F.lit(1), m["j"] - 1))
                right = part(F.substring(top["a"], m["i"] + m["k"], F.length(top["a"])), F.substring(top["b"], m["j"] + m["k"], F.length(top["b"])))
                parts = F.filter(F.array(left, right), both)
                todo = F.when(m["k"] > 0, F.concat(rest, parts)).otherwise(rest)
                return F.struct(todo.alias("todo"), (state["n"] + m["k"]).alias("n"))
            return _let(_longest_match(top["a"], top["b"]), split)
        size = F.size(state["todo"])
        return F.when(size == 0, state).otherwise(_let(F.get(state["todo"], size - 1), lambda top: matched(top, F.slice(state["todo"], F.lit(1), size - 1))))

    steps = F.sequence(F.lit(1), 2 * F.least(F.length(a), F.length(b)) + 1)
    return F.aggregate(steps, start, step, lambda state: state["n"])


def similarity(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of two texts (``a`` in the place of the candidate), 1 for two empty ones.

    Same blocks and ties as the standard library's matcher, whose shortcut for texts of 200 and more
    characters (it leaves out frequent ones) isn't made.
    """
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(F.lit(2.0) * matched_characters(a, b) / total)


def _tokens(text: str):
    """A text's characters, numbered by occurrence, so that set overlap is multiset overlap."""
    chars = F.split(F.col(text), "(?!$)")
    return F.transform(chars, lambda c, i: F.concat(
        c, F.lit("#"), F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c)).cast("string")))


def _rare_first(df: DataFrame, text: str, freq: DataFrame, cutoff: float) -> DataFrame:
    """(text, text_tokens, tok): one row per token of the prefix that a partner must touch.

    A partner of a text of length l shares at least ``cutoff * l / (2 - cutoff)`` tokens with it, so
    in any common order of tokens the two prefixes of length ``l - that + 1`` meet. Rare tokens come first.
    """
    need = F.ceil(F.lit(cutoff) * F.size("toks") / (2 - cutoff) - 1e-9)
    return (df.select(text, F.explode(_tokens(text)).alias("tok"))
            .join(freq, "tok", "left")
            .groupBy(text).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "tok"))).alias("s"))
            .select(text, F.transform("s", lambda x: x["tok"]).alias("toks"))
            .select(text, F.col("toks").alias(f"{text}_tokens"),
                    F.explode(F.slice("toks", F.lit(1), (F.size("toks") - need + 1).cast("int"))).alias("tok")))


def dimension_bounds(names: DataFrame) -> tuple[int, int]:
    """(number of distinct names, longest name): one small aggregate bounding both dimension-side tables."""
    row = names.agg(F.countDistinct("operator_name").alias("n"),
                    F.coalesce(F.max(F.length("operator_name")), F.lit(0)).alias("m")).first()
    return int(row["n"]), int(row["m"])


def fuzzy_pairs(typed: DataFrame, names: DataFrame, cutoff: float = K.FUZZY_CUTOFF,
                bounds: tuple[int, int] | None = None) -> DataFrame:
    """(typed, name, common): the pairs whose ratio can reach ``cutoff``.

    Pairs are generated by an equi-join on the rarest numbered characters of both sides (a prefix
    filter, which loses no pair that can reach ``cutoff``; frequent syllables are never keys of a text
    that has rarer ones) and pruned by the length bound and the multiset bound ``2*common/(la+lb)``,
    both upper bounds of the ratio. Typed texts too long for every name are left out first, so all
    token arrays are short. ``bounds`` = :func:`dimension_bounds` when known; the (name, token)
    table has at most names x longest name rows.
    """
    n_names, max_len = bounds if bounds is not None else dimension_bounds(names)
    t = (typed.select(F.col("typed")).distinct()
         .where((F.col("typed") != "") & (F.length("typed") * cutoff <= max_len * (2 - cutoff) + 1e-9)))
    nm = names.select(F.col("operator_name").alias("name")).distinct().where(F.col("name") != "")
    n_tokens = n_names * max_len
    freq = bounded_broadcast(nm.select(F.explode(_tokens("name")).alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("freq")),
                             known_rows=n_tokens)
    name_side = bounded_broadcast(_rare_first(nm, "name", freq, cutoff), known_rows=n_tokens)
    la, lb = F.length("name"), F.length("typed")
    return (_rare_first(t, "typed", freq, cutoff).join(name_side, "tok")
            .where(F.lit(2.0) * F.least(la, lb) / (la + lb) >= cutoff)
            .dropDuplicates(["typed", "name"])
            .select("typed", "name", F.size(F.array_intersect("typed_tokens", "name_tokens")).cast("long").alias("common"))
            .where(F.lit(2.0) * F.col("common") / (la + lb) >= cutoff))


def fuzzy_matches(typed: DataFrame, names: DataFrame, n: int = K.FUZZY_TOP,
                  cutoff: float = K.FUZZY_CUTOFF, bounds: tuple[int, int] | None = None) -> DataFrame:
    """Top-``n`` names per distinct typed text with ratio >= ``cutoff``: (typed, name, ratio, rank).

    Only the pruned pairs (:func:`fuzzy_pairs`) are scored with the exact ratio.
    """
    pairs = (fuzzy_pairs(typed, names, cutoff, bounds)
             # A generated column: the cutoff isn't pushed below it, which would work the ratio out twice a pair.
             .withColumn("ratio", F.explode(F.array(similarity(F.col("name"), F.col("typed")))))
             .where(F.col("ratio") >= cutoff))
    w = Window.partitionBy("typed").orderBy(F.col("ratio").desc(), F.col("name").desc())
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def resolve_operators(typed: DataFrame, operator_info: DataFrame, n: int = K.FUZZY_TOP,
                      cutoff: float = K.FUZZY_CUTOFF) -> DataFrame:
    """(user_id, typed) -> outcome blank / exact / suggest / none, match and suggestions.

    Work is done once per distinct stripped text, then joined back to users. The
    dimension is measured once (a two-number aggregate); the suggestion table (one
    row per distinct unmatched text) is joined by the planner, which AQE turns into
    a broadcast at run time when it is small; it is never computed twice for a check.
    """
    users = typed.select("user_id", F.col("typed").alias("raw"), py_strip(F.col("typed")).alias("typed"))
    names = operator_info.select("operator_name").distinct()
    bounds = dimension_bounds(names)
    exact = bounded_broadcast(names.select(F.col("operator_name").alias("typed"), F.lit(True).alias("is_exact")),
                              known_rows=bounds[0])
    texts = (users.select("typed").distinct().where(F.col("typed") != "")
             .join(exact, "typed", "left_anti"))
    fuzzy = fuzzy_matches(texts, names, n, cutoff, bounds)
    sugg = (fuzzy.groupBy("typed")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "name", "ratio"))).alias("s"))
            .select("typed", F.transform("s", lambda x: x["name"]).alias("suggestions")))
    out = (users.join(exact, "typed", "left")
           .join(sugg, "typed", "left"))
    outcome = (F.when(F.col("typed") == "", "blank")
               .when(F.coalesce(F.col("is_exact"), F.lit(False)), "exact")
               .when(F.col("suggestions").isNotNull(), "suggest")
               .otherwise("none"))
    return out.select(
        "user_id", "raw", "typed", outcome.alias("outcome"),
        F.when(F.col("is_exact"), F.col("typed")).alias("matched"),
        F.when(F.col("is_exact").isNull() & (F.col("typed") != ""), F.col("suggestions")).alias("suggestions"),
    )


def apply_resolution(answers: DataFrame, resolution: DataFrame, choices: DataFrame | None = None) -> DataFrame:
    """Set ``pension_operator`` from the resolution: an exact match becomes ``[matched]``; a
    suggestion takes effect only when the user picked it (``choices``: user_id, chosen).
    Users without a usable outcome keep their stored list. Joins are on user_id.
    """
    r = resolution.select("user_id", "matched")
    out = answers.join(r, "user_id", "left")
    if choices is not None:
        out = out.join(choices.select("user_id", "chosen"), "user_id", "left")
        picked = F.coalesce(F.col("matched"), F.col("chosen"))
    else:
        picked = F.col("matched")
    return out.withColumn(
        "pension_operator", F.when(picked.isNotNull(), F.array(picked)).otherwise(F.col("pension_operator"))
    ).drop("matched", "chosen")
