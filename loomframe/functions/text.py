"""Column functions on instructions, commands and tagged model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Substrings that make a command unsafe (fixed values).
BANNED = (";", "&&", "||", "`", "$", "<", ">")
FIELDS = ("COMMAND:", "CONFIDENCE:", "EXPLANATION:", "ALTERNATIVES:")
#: What counts as a number: digits, in groups with an underscore between if need be; no suffixes or hexadecimals.
DIGITS = "[0-9]+(_[0-9]+)*"
NUMBER = f"^[+-]?({DIGITS}([.]({DIGITS})?)?|[.]{DIGITS})([eE][+-]?{DIGITS})?$"
#: White space of Unicode, and the separators U+001C to U+001F.
SPACE = "(?U)[\\s\\x1c-\\x1f]+"


def normalize(text: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.lower(F.trim(F.regexp_replace(text, SPACE, " ")))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}\\z|\\A{SPACE[4:]}", "")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def tagged_field(text: Column, tag: str) -> Column:
    """Value of the last line that begins with the tag, every occurrence of which is taken out; null if none does."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.startswith(tag))
    return strip(F.replace(F.try_element_at(lines, F.lit(-1)), F.lit(tag), F.lit("")))


def to_number(text: Column) -> Column:
    """The number a text spells, infinite and not-a-number ones included, else 0."""
    sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
    return (
        F.when(text.rlike(NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
        .when(text.rlike("^(?i)[+-]?inf(inity)?$"), sign * F.lit(float("inf")))
        .when(text.rlike("^(?i)[+-]?nan$"), F.lit(float("nan")))
        .otherwise(F.lit(0.0))
    )


def alternatives(text: Column) -> Column:
    """Parts between pipes, trimmed, without empty ones."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "[|]"), strip)
    return F.filter(parts, lambda x: x != "")


def parse_output(text: Column) -> Column:
    """Struct of command, confidence, explanation and alternatives from tagged lines."""
    return F.struct(
        F.coalesce(tagged_field(text, "COMMAND:"), F.lit("")).alias("command"),
        F.coalesce(to_number(tagged_field(text, "CONFIDENCE:")), F.lit(0.0)).alias("confidence"),
        F.coalesce(tagged_field(text, "EXPLANATION:"), F.lit("")).alias("explanation"),
        alternatives(tagged_field(text, "ALTERNATIVES:")).alias("alternatives"),
    )


def is_safe(command: Column, tool: str) -> Column:
    """Not empty, begins with the tool's name and holds no banned substring."""
    ok = (command != "") & command.startswith(tool)
    for x in BANNED:
        ok = ok & ~command.contains(x)
    return ok


def passes(command: Column, confidence: Column, tool: str, threshold: float = 0.6) -> Column:
    """Safe and sure enough; a NaN is never sure."""
    return is_safe(command, tool) & ~F.isnan(confidence) & (confidence >= threshold)


def subcommand(command: Column) -> Column:
    """The second word, else the whole command."""
    w = words(command)
    return F.when(F.size(w) > 1, F.get(w, F.lit(1))).otherwise(command)


def first_word_in(command: Column, allowed: list[str]) -> Column:
    return F.coalesce(F.get(words(command), F.lit(0)).isin(allowed), F.lit(False))


def command_of(text: Column) -> Column:
    """What follows the command tag up to the line's end, else the first line; trimmed."""
    after = F.split_part(F.split_part(text, F.lit("COMMAND: "), F.lit(2)), F.lit("\n"), F.lit(1))
    return strip(F.when(text.contains("COMMAND: "), after).otherwise(F.split_part(text, F.lit("\n"), F.lit(1))))


def after_marker(text: Column, marker: str, end: str) -> Column:
    """What follows the last marker, up to the end marker."""
    return F.substring_index(F.substring_index(text, marker, -1), end, 1)


def expected_command(text: Column) -> Column:
    """What follows the first command tag and its space up to the next tag or the line's end, untrimmed; null without a tag."""
    return F.when(text.contains("COMMAND: "), F.split_part(F.split_part(text, F.lit("COMMAND: "), F.lit(2)), F.lit("\n"), F.lit(1)))


def two_places(x: Column) -> Column:
    """A number with two decimals; of two that are equally near the even one, by the decimal digits of the double."""
    return F.bround(x.cast("decimal(38,18)"), 2).cast("decimal(38,2)").cast("string")


def percent(share: Column, places: int = 0) -> Column:
    """A share as a percentage with so many decimals."""
    return F.concat(F.bround((share * 100).cast("decimal(38,12)"), places).cast(f"decimal(38,{places})").cast("string"), F.lit("%"))


def mebibytes(size: Column) -> Column:
    """Bytes in MiB, to two decimals."""
    return F.round(size / 1048576, 2)


def preview(command: Column, confidence: Column, explanation: Column, others: Column, success: Column) -> Column:
    """Lines that show a translation with its confidence, or that there is none."""
    shown = F.concat_ws(
        "\n",
        F.concat(F.lit("Command: "), command),
        F.concat(F.lit("Confidence: "), percent(confidence)),
        F.concat(F.lit("Explanation: "), explanation),
        F.when(F.size(others) > 0, F.concat(F.lit("Alternatives:"), F.array_join(F.transform(others, lambda x: F.concat(F.lit("\n  - "), x)), ""))),
    )
    return F.when(success, shown).otherwise(F.lit("No command found"))


def shared_prompt(chosen: Column, rejected: Column) -> Column:
    """Struct ``prompt``, ``chosen``, ``rejected``: the common beginning cut off both, up to a space before the first difference."""
    n = common_prefix_length(chosen, rejected)
    differ = n < F.least(F.length(chosen), F.length(rejected))
    n = F.when(differ & (n > 0) & (F.substring(chosen, n, F.lit(1)) == " "), n - 1).otherwise(n)
    rest = lambda x: F.substring(x, n + 1, F.length(x))
    return F.struct(F.substring(chosen, F.lit(1), n).alias("prompt"), rest(chosen).alias("chosen"), rest(rejected).alias("rejected"))


def rough_confidence(text: Column) -> Column:
    """0.9 up to five words, 0.7 up to ten, else 0.5."""
    n = F.size(words(text))
    return F.when(n <= 5, 0.9).when(n <= 10, 0.7).otherwise(0.5)


def fill(pattern: Column, **slots: Column) -> Column:
    """Replaces {name} by each slot's value."""
    for name, value in slots.items():
        pattern = F.replace(pattern, F.lit("{" + name + "}"), value)
    return pattern


def ends_with_once(text: Column, end: str) -> Column:
    return F.when(text.endswith(end), text).otherwise(F.concat(text, F.lit(end)))


def chat_turns(prompt: Column, answer: Column, end: str = "<eos>") -> Column:
    """One exchange in the turn format, with the end mark."""
    return F.concat(
        F.lit("<start_of_turn>user\n"), prompt, F.lit("<end_of_turn>\n<start_of_turn>model\n"), answer, F.lit("<end_of_turn>" + end)
    )


def with_input(instruction: Column, given: Column) -> Column:
    return F.concat(instruction, F.when(given != "", F.concat(F.lit("\n"), given)).otherwise(F.lit("")))


def inst_prompt(text: Column) -> Column:
    return F.concat(F.lit("<s>[INST] "), text, F.lit(" [/INST]"))


def header_prompt(instruction: Column, response: Column) -> Column:
    return F.concat(F.lit("### Instruction:\n"), instruction, F.lit("\n\n### Response:\n"), response)


def without_prompt(text: Column, prompt: Column) -> Column:
    """What follows a prompt that the text begins with."""
    return F.substring(text, F.length(prompt) + 1, F.length(text))


def common_prefix_length(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    # the first place at which the characters differ; beyond the shorter text they do
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y))
    first = F.array_position(pairs, True).cast("int")
    n = F.least(F.length(a), F.length(b))
    return F.when(n == 0, 0).when(first == 0, n).otherwise(F.least(first - 1, n))


def unit_hash(*cols: Column) -> Column:
    """A number in 0 to 1 from an md5 of the columns."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
