"""Text expressions: tokenizing, names, numerals, clause marks, rewrites and titles. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
#: The numerals that article and clause numbers use.
NUMERALS = "零一二三四五六七八九"
NUMBER_CLASS = "零一二三四五六七八九十百千"
#: Whitespace that titles lose, besides the ASCII kinds.
WIDE_SPACES = r"[\s\x{2002}\x{3000}\x{a0}]+"
PARENT = f"^(第[{NUMBER_CLASS}]+条(?:之[{NUMBER_CLASS}]+)?)"
CLAUSE_LABEL = f"第[{NUMBER_CLASS}]+款$"


def tokens(text: Column, dictionary: list[str] | None = None) -> Column:
    """Lower-cased words; words of the dictionary stay whole, the longest first."""
    pattern = TOKEN
    if dictionary:
        longest = sorted({w.lower() for w in dictionary}, key=lambda w: (-len(w), w))
        pattern = "|".join([*(f"\\Q{w}\\E" for w in longest), TOKEN])
    return F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"))


def cjk_tokens(text: Column, dictionary: list[str]) -> Column:
    """Dictionary words, else single CJK characters, else runs of other letters and digits."""
    longest = sorted(set(dictionary), key=lambda w: (-len(w), w))
    pattern = "|".join([*(f"\\Q{w}\\E" for w in longest), r"[\x{4e00}-\x{9fff}]", r"[\p{L}\p{N}&&[^\x{4e00}-\x{9fff}]]+"])
    return F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"))


def clean_title(title: Column) -> Column:
    return F.regexp_replace(title, WIDE_SPACES, "")


def source_name(name: Column) -> Column:
    """A file's stem or a stored name without its date suffix, ``+`` read as a space."""
    return F.replace(F.regexp_replace(F.trim(name), r"_\d{8}$", ""), F.lit("+"), F.lit(" "))


def marked_source(name: Column) -> Column:
    """The name in title marks, once."""
    plain = source_name(name)
    return F.when(plain.startswith("《") & plain.endswith("》") | (plain == ""), plain).otherwise(F.concat(F.lit("《"), plain, F.lit("》")))


def category(path: Column) -> Column:
    """The folder right above the file in a path relative to the corpus; empty at its root."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("")


def parent_number(number: Column) -> Column:
    found = F.regexp_extract(number, PARENT, 1)
    return F.when(found == "", number).otherwise(found)


def clause_label(number: Column) -> Column:
    return F.regexp_extract(F.trim(number), CLAUSE_LABEL, 0)


def without_clause(number: Column) -> Column:
    return F.trim(F.regexp_replace(number, CLAUSE_LABEL, ""))


def numeral(text: Column) -> Column:
    """Value of a numeral up to the thousands; 0 for anything else."""

    def part(unit: str, value: int, implied: int) -> Column:
        found = F.regexp_extract(text, f"([{NUMERALS}]?){unit}", 0)
        mark = F.regexp_extract(text, f"([{NUMERALS}]?){unit}", 1)
        return F.when(found == "", 0).when(mark == "", implied * value).otherwise(_digit(mark) * value)

    last = F.regexp_extract(text, f"([{NUMERALS}])$", 1)
    ones = F.when(last == "", 0).otherwise(_digit(last))
    total = part("千", 1000, 1) + part("百", 100, 1) + part("十", 10, 1) + ones
    return F.when(text.rlike(f"^[{NUMBER_CLASS}]+$"), total).otherwise(0)


def _digit(mark: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[x for i, c in enumerate(NUMERALS) for x in (F.lit(c), F.lit(i))]), mark), F.lit(0))


#: Fixed value: what normalized text lacks, white space and common punctuation.
PLAIN_SIGNS = r"(?U)[\s\x{3000}，。！？、,.!?;；:：()（）]+"


def normalized(text: Column) -> Column:
    """Lower case without white space and common punctuation; null is empty."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), PLAIN_SIGNS, "")


def lexical_text(*parts: Column) -> Column:
    """The parts that aren't empty, joined by spaces."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def stripped_negation(text: Column, marks: list[str]) -> Column:
    """The text without its negation marks and the blanks after them; longer marks first."""
    alternatives = "|".join(sorted(marks, key=lambda m: (-len(m), m)))
    return F.regexp_replace(text, f"({alternatives})\\s*", "")


def rewrite_lines(answer: Column, most: int) -> Column:
    """Distinct lines of a model's answer without numbers, bullets and quotes; at most ``most``."""
    lines = F.transform(F.split(answer, "\n"), lambda x: F.regexp_replace(F.trim(x), r"^(?:\d+[.、)]|[-*•])\s*", ""))
    lines = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^[\"“”']+|[\"“”']+$", "")))
    return F.slice(F.array_distinct(F.filter(lines, lambda x: x != "")), 1, most)


def sanitized_rewrite(answer: Column, longest: int = 200) -> Column:
    """The first line of a model's rewrite without its thoughts, label and quotes; null if empty or too long."""
    text = stripped(F.regexp_replace(answer, r"(?s)<think>.*?</think>", ""))
    text = F.trim(F.element_at(F.split(text, "\n"), 1))
    text = F.trim(F.regexp_replace(text, r"^(?:改写后?的?问题|改写|rewritten question|rewrite)\s*[:：]\s*", ""))
    text = F.regexp_replace(text, r"^[\"“”']+|[\"“”']+$", "")
    return F.when((text != "") & (F.char_length(text) <= longest), text)


def stripped(text: Column) -> Column:
    """Without white space of any script, line ends included, at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def any_in(text: Column, words: Column) -> Column:
    """Whether the text contains one of an array of words."""
    return F.exists(words, lambda w: F.contains(text, w))


def level(number: Column) -> Column:
    return F.size(F.split(number, r"\."))


def glyphs(line: Column) -> Column:
    """PDF text with shifted punctuation, full-width letters and split clause numbers set right; lines that mostly
    are real Yi script keep their characters."""
    # Single glyphs that extraction mistakes, then the shifted and the full-width ranges.
    single = {"ꎮ": "。", "«": "《", "»": "》", "￣": "—"}
    digits = {chr(0xA3B0 + i): chr(0x30 + i) for i in range(10)}
    shifted = {chr(c): chr(0xFF00 + c - 0xA3A0) for c in range(0xA3A1, 0xA3C0)}
    narrow = {chr(c): chr(c - 0xFEE0) for low, high in ((0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)) for c in range(low, high + 1)}
    table = shifted | narrow | digits | single
    fixed = F.translate(line, "".join(table), "".join(table.values()))
    yi = F.char_length(F.regexp_replace(line, r"[^\x{A000}-\x{A3A0}\x{A3C0}-\x{A4CF}]", ""))
    real = yi * 2 >= F.char_length(line)
    return F.regexp_replace(F.when(real, line).otherwise(fixed), r"(\d)\.\s+(?=\d)", "$1.")


#: Fixed value: leader dots, as between a title and its page.
LEADER = r"[….．·]{3,}"


def has_leader(line: Column) -> Column:
    """A line with leader dots, perhaps between other text."""
    return line.rlike(LEADER)


def dot_leader(line: Column) -> Column:
    """A line of leader dots and nothing else."""
    return line.rlike(LEADER) & (stripped(F.regexp_replace(line, LEADER, "")) == "")


def table_text(rows: Column) -> Column:
    """An array of arrays of cells as lines of cells."""
    clean = lambda c: glyphs(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(F.filter(r, lambda c: c.isNotNull()), clean), " | ")), "\n")
