"""Column functions on strings; all built-in expressions.

``(?U)`` makes ``\\s`` Unicode-aware, so that no-break and ideographic spaces
count as white space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bracket pairs that a finished sentence has closed.
PAIRS = ["()", "‘’", "“”", "〈〉", "<>", "《》", "「」", "『』", "[]"]
#: How a finished sentence ends.
ENDINGS = ["다.", "다", ".", "!", "?", "요.", "함.", "임.", "음."]
#: Look-alike quotes, dots and dashes, and what they become.
LOOKALIKES = ("‘’“”＇＂․∙―–—", "''\"\"'\"··---")
#: Private-use characters, glyphs whose meaning is lost, and how headings begin.
PRIVATE_USE = r"[\x{E000}-\x{F8FF}\x{F0000}-\x{10FFFD}]"
HEADING = r"^(?:\d+(?:\.\d+)*|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+|[가-힣])[.)]\s*\S"
PDF_HEADING = r"^(?:\d+(?:\.\d+)*|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+)[.)]\s*\S"
#: Fixed value: marks of a list item.
BULLET = r"^\s*(?:[✓✔✗✕•·▪◦●○]|[-–—]|\d+[.)]\s)\s*"


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def unspaced(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")


def tokens(text: Column) -> Column:
    """White-space separated tokens, as they are."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda t: t != "")


def normalized(text: Column) -> Column:
    """Evidence normaliser after compatibility composition: glyphs, look-alikes, footnote marks, white space."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), PRIVATE_USE, "□")
    t = F.translate(t, *LOOKALIKES)
    return squeeze(F.regexp_replace(t, r"""(?<=[가-힣.'")])\d{1,2}\)""", ""))


#: Quotes, dots and dashes that verdicts and claims write differently.
ALIKE = ("‘’“”․∙–—", "''\"\"··--")


def alike(text: Column) -> Column:
    """Form by which verdicts find their claim, after compatibility composition: glyphs and footnote marks stay."""
    return squeeze(F.translate(F.coalesce(text, F.lit("")), *ALIKE))


def at_end(pattern: str) -> str:
    """The pattern with ``$`` as the very end, as SQL has it: here it would also stand before a last line break."""
    return pattern.replace("$", r"\z")


def is_heading(text: Column, pattern: str = HEADING, closed: tuple[str, ...] = ("다.",)) -> Column:
    t = F.trim(text)
    return t.rlike(pattern) & (F.length(t) <= 60) & ~_ends_in(t, closed)


def is_running_head(line: Column) -> Column:
    """Short line with a page number at either end that does not end like a sentence."""
    t = F.trim(line)
    numbered = t.rlike(r"^\d{1,4}\s+\S|\s\d{1,4}\z")
    return (t != "") & (F.length(t) <= 45) & ~_ends_in(t, (".", "다", "?", "!", ":")) & numbered


def is_unbalanced(text: Column) -> Column:
    """Whether a bracket or quote is open that is not closed, or the reverse."""
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    out = F.lit(False)
    for opened, closed in PAIRS:
        out = out | (count(opened) != count(closed))
    return out


def is_finished(text: Column) -> Column:
    return _ends_in(F.rtrim(text), tuple(ENDINGS))


def _ends_in(text: Column, ends: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for e in ends:
        out = out | text.endswith(e)
    return out


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters, white space left out; fewer than two characters have none."""
    t = unspaced(text)
    pairs = lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, 2))
    return F.when(F.length(t) > 1, F.array_distinct(F.transform(F.array(t), pairs)[0])).otherwise(F.array().cast("array<string>"))


def evidence_parts(raw: Column, least: int = 6) -> Column:
    """Pieces of quoted evidence that may stand in the source: cut at `` || `` and ellipses, page notes and comments dropped."""
    pieces = F.flatten(F.transform(F.split(raw, r" \|\| "), lambda c: F.split(c, r"(?U)\s*(?:\.{2,}|…|⋯)\s*")))
    clean = F.transform(
        pieces,
        lambda p: F.trim(
            F.regexp_replace(
                F.regexp_replace(p, r"(?U)\s*[（(]\s*p\.?\s*\d+[^)）]*[)）]\s*$", ""), r"(?U)\s*[—–]\s*[^—–]+$", ""
            )
        ),
    )
    kept = F.filter(clean, lambda p: F.length(p) >= least)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.trim(raw)))


def box_parts(text: Column, least: int = 20) -> Column:
    """Lines of a text box, if two or more are long enough; else the box as it is."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    long = F.size(F.filter(lines, lambda x: F.length(x) >= least)) >= 2
    return F.when(long, lines).otherwise(F.array(F.trim(text)))


def bullet_claims(text: Column) -> Column:
    """Items of a box in which every line is a bullet, else the box; marks are dropped."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    every = (F.size(lines) > 1) & F.forall(lines, lambda x: x.rlike(BULLET))
    plain = F.trim(F.regexp_replace(F.trim(text), BULLET, ""))
    items = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, BULLET, "")))
    return F.filter(F.when(every, items).otherwise(F.array(plain)), lambda x: x != "")


def clean_body(text: Column) -> Column:
    """Body clean-up: look-alike characters, lost glyphs, footnote marks, runs of blanks and of empty lines."""
    t = F.translate(text, "․∙． ", "··. ")
    t = F.regexp_replace(t, PRIVATE_USE, "□")
    t = F.regexp_replace(t, r"""(?<=[가-힣.’”"')])(\d{1,2})\)""", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def latin_ratio(text: Column) -> Column:
    """ASCII letters among all letters; 0 without letters."""
    letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(text, r"[^A-Za-z]", "")) / letters).otherwise(0.0)


def normalized_deck(deck: Column) -> Column:
    """Deck id in lower case, without spaces and suffix, long domain names spelt out."""
    t = F.regexp_replace(F.substring_index(F.lower(F.trim(deck)), "__", 1), " ", "")
    return F.regexp_replace(t, r"^fin_", "finance_")


def slide_number(text: Column) -> Column:
    """The digits of a slide field as a number; 1 where there are none."""
    return F.coalesce(F.regexp_replace(text, r"[^0-9]", "").try_cast("int"), F.lit(1))


def context_items(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def is_test_marker(text: Column) -> Column:
    return text.rlike(r"^\s*1(\D|$)")


#: The domain that a document's prefix stands for.
DOMAINS = {"socio": "사회학", "arts": "예체능", "bio": "바이오/의료", "tech": "기술/공학", "finance": "재무/경제"}


def inferred_domain(domain: Column, doc: Column) -> Column:
    """A domain that is empty or unreadable, as the document's prefix has it; else as it is."""
    unreadable = (F.coalesce(domain, F.lit("")) == "") | F.contains(domain, F.lit("?"))
    guess = F.when(~unreadable, domain)
    for prefix, name in DOMAINS.items():
        guess = guess.when(F.startswith(doc, F.lit(prefix)), name)
    return guess.otherwise(domain)


def first_present(*columns: Column) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])
