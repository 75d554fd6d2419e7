"""Token-sort similarity as JVM-side expressions.

The score of two strings is ``200 * LCS / (len a + len b)`` over their sorted tokens. The
longest common subsequence is found with the bit-parallel recurrence
``V' = (V + (V & M)) | (V & ~M)``: one step per character of one string, where ``M`` marks
the positions of that character in the other. Blocks of 60 bits keep the sums inside a
signed 64-bit integer, so the recurrence is exact under ANSI arithmetic for any length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallystar.functions.text import bind, words_of

_BLOCK = 60
_FULL = (1 << _BLOCK) - 1


def sorted_tokens(text: Column) -> Column:
    return F.array_join(F.array_sort(words_of(text)), " ")


def characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), i.cast("int"))


def _block_numbers(length: Column) -> Column:
    return F.sequence(F.lit(0), (F.greatest(length - 1, F.lit(0)) / _BLOCK).cast("int"))


def _block_masks(chars: Column, wanted: Column) -> Column:
    """Per block of 60 positions, the bits at which ``wanted`` stands."""
    return F.transform(
        _block_numbers(F.size(chars)),
        lambda b: F.aggregate(
            F.transform(
                F.slice(chars, b * _BLOCK + 1, F.lit(_BLOCK)),
                lambda c, i: F.when(c == wanted, _bit(i)).otherwise(F.lit(0).cast("bigint")),
            ),
            F.lit(0).cast("bigint"),
            lambda acc, bit: acc.bitwiseOR(bit),
        ),
    )


def position_masks(chars: Column) -> Column:
    """Map from each character to its position bits; computed once per string, not per pair."""
    return bind(
        F.array_distinct(chars),
        lambda distinct: F.map_from_arrays(distinct, F.transform(distinct, lambda w: _block_masks(chars, w))),
    )


def _ones(count: Column) -> Column:
    return _bit(count) - 1


def _start_blocks(length: Column) -> Column:
    return F.transform(
        _block_numbers(length),
        lambda b: _ones(F.least(length - b * _BLOCK, F.lit(_BLOCK))),
    )


def _one_block(masks: Column, length: Column) -> Column:
    def run(ones: Column) -> Column:
        end = F.aggregate(
            masks,
            ones,
            lambda v, m: (v + v.bitwiseAND(m[0])).bitwiseAND(ones).bitwiseOR(v.bitwiseAND(F.bitwise_not(m[0]))),
        )
        return length - F.bit_count(end)

    return bind(_ones(length), run)


def _many_blocks(masks: Column, length: Column) -> Column:
    return bind(_start_blocks(length), lambda start: _fold_blocks(masks, length, start))


def _fold_blocks(masks: Column, length: Column, start: Column) -> Column:
    empty = F.struct(
        F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("blocks")
    )

    def step(state: Column, mask: Column) -> Column:
        pairs = F.arrays_zip(state.alias("v"), mask.alias("m"), start.alias("w"))

        def fold(acc: Column, p: Column) -> Column:
            total = p["v"] + p["v"].bitwiseAND(p["m"]) + acc["carry"]
            kept = total.bitwiseAND(p["w"]).bitwiseOR(p["v"].bitwiseAND(F.bitwise_not(p["m"])))
            return F.struct(
                F.shiftright(total, _BLOCK).alias("carry"),
                F.concat(acc["blocks"], F.array(kept)).alias("blocks"),
            )

        return F.aggregate(pairs, empty, fold, lambda acc: acc["blocks"])

    end = F.aggregate(masks, start, step)
    set_bits = F.aggregate(end, F.lit(0), lambda n, v: n + F.bit_count(v))
    return length - set_bits


def lcs_length(masks_a: Column, length_a: Column, chars_b: Column) -> Column:
    """LCS of two strings, one given by its position masks and length, the other by characters."""
    masks = F.filter(
        F.transform(chars_b, lambda c: F.try_element_at(masks_a, c)), lambda m: m.isNotNull()
    )
    length = length_a.cast("int")
    return F.when(length <= _BLOCK, _one_block(masks, length)).otherwise(
        bind(masks, lambda found: _many_blocks(found, length))
    )


def ratio(lcs: Column, length_a: Column, length_b: Column) -> Column:
    return F.lit(200.0) * lcs / (length_a + length_b)


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Score 0..100 of one pair held in one row; case-sensitive."""
    pair = F.struct(
        characters(sorted_tokens(a)).alias("left"), characters(sorted_tokens(b)).alias("right")
    )

    def score(p: Column) -> Column:
        left, right = p["left"], p["right"]
        lcs = bind(position_masks(left), lambda masks: lcs_length(masks, F.size(left), right))
        return (
            F.when(F.size(left) + F.size(right) == 0, F.lit(100.0))
            .when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0))
            .otherwise(ratio(lcs, F.size(left), F.size(right)))
        )

    return bind(pair, score)
