"""Text predicates and functions as columns."""

from __future__ import annotations

import re
import string
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of each group; a text scores one point for every group it has a word of.
FRENCH = (
    ("le", "la", "les", "un", "une", "des", "du", "au", "aux"),
    ("est", "sont", "ont", "avoir", "être", "aller", "faire"),
    ("bonjour", "merci", "oui", "non", "monsieur", "madame", "mademoiselle"),
    ("et", "ou", "mais", "donc", "car", "ni", "or"),
    ("ce", "cette", "ces", "cet"),
    ("pour", "dans", "sur", "avec", "sans", "chez"),
)
ENGLISH = (
    ("the", "a", "an", "of", "in", "on", "at", "for", "to", "with", "by"),
    ("is", "are", "was", "were", "has", "have", "had", "be", "been", "being"),
    ("hello", "thank you", "yes", "no", "sir", "madam", "miss"),
    ("and", "or", "but", "so", "because", "neither", "nor"),
    ("this", "that", "these", "those"),
    ("for", "in", "on", "with", "without", "at"),
)
#: Letters, digits and the underscore of ASCII make words; letters with accents part them.
INSIDE = "[0-9A-Za-z_]"
WHOLE_WORD = re.compile(f"{INSIDE}+")


def words_of(text: Column, wanted: tuple[str, ...]) -> Column:
    """Those of ``wanted`` that the text has between two word edges, in either case of letters.

    The text is split into its words once. What is no single word of ASCII is looked for apart.
    """
    plain = [w for w in wanted if WHOLE_WORD.fullmatch(w)]
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    found = F.array_intersect(F.split(low, "[^0-9a-z_]+"), F.array(*map(F.lit, plain)))
    for w in wanted:
        if w not in plain:
            # an edge lies between a character of a word and one that is none
            before, after = (f"(?{look}{'!' if WHOLE_WORD.match(c) else '='}{INSIDE})" for look, c in (("<", w[0]), ("", w[-1])))
            there = F.lower(text).contains(w) & text.rlike(f"(?iu){before}{w}{after}")
            found = F.concat(found, F.when(there, F.array(F.lit(w))).otherwise(F.array().cast("array<string>")))
    return found


def scores(text: Column) -> Column:
    """struct(fr, en): how many groups of each language the text has a word of; null without a text."""
    groups = {"fr": FRENCH, "en": ENGLISH}
    wanted = tuple(dict.fromkeys(w for language in groups.values() for g in language for w in g))

    def count(held: Column, language: tuple[tuple[str, ...], ...]) -> Column:
        return reduce(lambda a, b: a + b, [F.arrays_overlap(held, F.array(*map(F.lit, g))).cast("int") for g in language])

    # a list of one, so that the words are found once for all groups
    return F.transform(F.array(words_of(text, wanted)), lambda held: F.struct(*[count(held, g).alias(name) for name, g in groups.items()]))[0]


def detect_language(text: Column) -> Column:
    """``fr`` if strictly more French than English groups occur, else ``en``."""
    found = scores(text)
    return F.when(found["fr"] > found["en"], "fr").otherwise("en")


def trimmed(text: Column) -> Column:
    """Without any white space at both ends, not only spaces."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(trimmed(text), F.lit("")) == ""


def is_long_enough(text: Column, length: int = 10) -> Column:
    return F.length(text) > length


def is_substantial(text: Column) -> Column:
    """Over three characters and not digits and signs alone."""
    # Fixed value: the pattern of digits and signs.
    return (F.length(trimmed(text)) > 3) & ~text.rlike(r"""^[0-9\s.,;:!?()\[\]{}'"<>/\\|@#$%^&*_=+-]*$""")


def unclear_link(text: Column, least: int = 5) -> Column:
    """Missing, shorter than ``least`` when trimmed, or an address."""
    low = F.lower(text)
    return F.coalesce(text, F.lit("")).eqNullSafe("") | (F.length(trimmed(text)) < least) | low.contains("http") | low.contains("www")


def raw_url_link(text: Column, target: Column) -> Column:
    text = trimmed(text)
    there = (F.coalesce(text, F.lit("")) != "") & (F.coalesce(target, F.lit("")) != "")
    return there & ((text == target) | text.startswith("http"))


def without_ellipsis(text: Column) -> Column:
    return F.regexp_replace(text, r"\.\.\.$", "")


def ordered_join(order: list[str], text: str, sep: str) -> Column:
    """An aggregate: the texts of a group in the order of the columns, joined."""
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("joined_text"))))
    return F.array_join(F.transform(rows, lambda r: r["joined_text"]), sep)
