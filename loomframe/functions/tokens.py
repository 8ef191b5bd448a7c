"""Column functions on token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED = -100


def keep_last(ids: Column, n: int) -> Column:
    return F.slice(ids, F.greatest(F.size(ids) - n + 1, F.lit(1)), F.lit(n))


def keep_first(ids: Column, n: int) -> Column:
    return F.slice(ids, F.lit(1), F.lit(n))


def close(ids: Column, eos: int) -> Column:
    """With the end token, unless it is last already."""
    return F.when(F.try_element_at(ids, F.lit(-1)) == eos, ids).otherwise(F.concat(ids, F.array(F.lit(eos))))


def open_with(ids: Column, bos: int) -> Column:
    return F.when((F.size(ids) == 0) | (F.try_element_at(ids, F.lit(1)) != bos), F.concat(F.array(F.lit(bos)), ids)).otherwise(ids)


def open_once(ids: Column, text: Column, bos_text: str, bos: int) -> Column:
    """Opened unless the text, whose tokens these are, begins with the opening's own text: a template may have written it."""
    return F.when(F.coalesce(F.startswith(text, F.lit(bos_text)), F.lit(False)), ids).otherwise(open_with(ids, bos))


def pad_right(ids: Column, n: int, pad: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(F.lit(n) - F.size(ids), F.lit(0))))


def pad_left(ids: Column, n: int, pad: int) -> Column:
    return F.concat(F.array_repeat(F.lit(pad), F.greatest(F.lit(n) - F.size(ids), F.lit(0))), ids)


def pack_left(ids: Column, pad: int) -> Column:
    """Padding moved to the right, the rest in order."""
    return F.concat(F.filter(ids, lambda x: x != pad), F.filter(ids, lambda x: x == pad))


def left_padding(ids: Column, pad: int) -> Column:
    """Count of padding before the first token."""
    kept = F.transform(ids, lambda x, i: F.when(x != pad, i))
    return F.coalesce(F.array_min(kept), F.size(ids))


def mask_labels(prompt: Column, answer: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(IGNORED), F.size(prompt)), answer)


def until_first(ids: Column, stop: int) -> Column:
    """Tokens up to and with the first stop token."""
    at = F.array_position(ids, stop).cast("int")
    return F.when(at > 0, F.slice(ids, F.lit(1), at)).otherwise(ids)


def cut_off(ids: Column, ends: list[int]) -> Column:
    """Whether the last token is none of the ends."""
    return ~F.coalesce(F.try_element_at(ids, F.lit(-1)).isin(ends), F.lit(False))


def replace_token(ids: Column, old: int, new: int) -> Column:
    return F.transform(ids, lambda x: F.when(x == old, F.lit(new)).otherwise(x))


def completion_mask(n_prompt: Column, ids: Column, pad: int) -> Column:
    """1 on completion tokens, 0 on the prompt and padding."""
    return F.transform(ids, lambda x, i: F.when((i >= n_prompt) & (x != pad), 1).otherwise(0))


def differing(a: Column, b: Column) -> Column:
    """Positions at which two arrays differ, over the shorter one."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: (x != y).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda t, x: t + x)


def step_labels(steps: Column, labels: Column, last_only: bool = False) -> Column:
    """For steps of token arrays: ignored but at each step's last token, which has the step's label, or at the last step's only."""
    if last_only:
        labels = F.transform(labels, lambda y, i: F.when(i == F.size(labels) - 1, y.cast("int")).otherwise(IGNORED))
    none = F.array().cast("array<int>")
    mark = lambda s, y: F.concat(F.array_repeat(F.lit(IGNORED), F.size(s) - 1), F.array(y.cast("int")))
    # a step without tokens has no place for a label
    return F.flatten(F.zip_with(steps, labels, lambda s, y: F.when(F.size(s) > 0, mark(s, y)).otherwise(none)))


def step_example(prompt: Column, steps: Column, labels: Column, separator: int, prompt_limit: int, answer_limit: int, limit: int, last_only: bool = False) -> Column:
    """Struct ``ids``, ``labels``: each step closed by the separator, prompt and answer cut to their limits and both to the whole's."""
    closed = F.transform(steps, lambda s: F.concat(s, F.array(F.lit(separator))))
    p = keep_last(prompt, prompt_limit)
    ids = keep_first(F.concat(p, keep_first(F.flatten(closed), answer_limit)), limit)
    marks = keep_first(mask_labels(p, keep_first(step_labels(closed, labels, last_only), answer_limit)), limit)
    return F.struct(ids.alias("ids"), marks.alias("labels"))


def mask_cut(mask: Column, cut: Column) -> Column:
    """The mask of a completion, all zero if it was cut off; the row stays."""
    return F.transform(mask, lambda m: F.when(cut, 0).otherwise(m))


def add_at(values: Column, position: Column, amount: Column) -> Column:
    """An array with an amount added at one position from 0."""
    return F.transform(values, lambda v, i: F.when(i == position, v + amount).otherwise(v))


def scatter(mask: Column, values: Column, pad: float = 0.0) -> Column:
    """The values in order at the ones of a mask, padding elsewhere; ones beyond the values' end have null."""
    places = lambda on: F.filter(F.transform(mask, lambda m, i: F.when(F.coalesce(m == 1, F.lit(False)) == on, i)), lambda x: x.isNotNull())
    ones = places(True)
    filled = F.zip_with(ones, F.slice(values, F.lit(1), F.size(ones)), lambda i, v: F.struct(i.alias("i"), (v * 1.0).alias("v")))
    padded = F.transform(places(False), lambda i: F.struct(i.alias("i"), F.lit(float(pad)).alias("v")))
    return F.transform(F.array_sort(F.concat(filled, padded)), lambda x: x["v"])


def flush_left(ids: Column, pad: int, limit: int) -> Column:
    """Padding moved to the right, then cut to the limit."""
    return keep_first(pack_left(ids, pad), limit)


def sequence_logprob(logps: Column, labels: Column, average: bool = False) -> Column:
    """Sum (or mean) of the log-probabilities whose label isn't ignored; nothing to sum gives 0."""
    kept = F.filter(F.zip_with(logps, labels, lambda p, y: F.when(y != IGNORED, p)), lambda x: x.isNotNull())
    total = F.aggregate(kept, F.lit(0.0), lambda t, x: t + x)
    return total / F.greatest(F.size(kept), F.lit(1)) if average else total


def common_width(*arrays: Column) -> Column:
    """The size of the longest of the arrays."""
    return F.greatest(*[F.size(a) for a in arrays])


def pad_to(ids: Column, n: Column, pad: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(n - F.size(ids), F.lit(0))))


def selected_logprob(logits: Column, index: Column) -> Column:
    from loomframe.functions.scores import logsumexp

    return F.get(logits, index) - logsumexp(logits)


def split_at_prompt(full: Column, prompt: Column) -> Column:
    """Struct ``prompt``, ``answer``: the full array cut behind the prompt, one token earlier if joining changed its last."""
    n = F.size(prompt)
    at = F.when(F.slice(full, F.lit(1), n) == prompt, n).otherwise(F.greatest(n - 1, F.lit(0)))
    return F.struct(F.slice(full, F.lit(1), at).alias("prompt"), F.slice(full, at + 1, F.greatest(F.size(full) - at, F.lit(0))).alias("answer"))


def fit_pair(prompt: Column, answer: Column, limit: int, prompt_limit: int, keep: str = "keep_end") -> Column:
    """Struct ``prompt``, ``answer`` within the limit: a pair that is too long loses prompt first, then answer, if need be all of it."""
    if keep not in ("keep_end", "keep_start"):
        raise ValueError("keep is keep_end or keep_start")
    cut = keep_last(prompt, prompt_limit) if keep == "keep_end" else keep_first(prompt, prompt_limit)
    p = F.when(F.size(prompt) + F.size(answer) > limit, cut).otherwise(prompt)
    a = F.when(F.size(p) + F.size(answer) > limit, keep_first(answer, max(limit - prompt_limit, 0))).otherwise(answer)
    return F.struct(p.alias("prompt"), a.alias("answer"))
