"""Text kernels as column expressions: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters folded one to one, characters folded to several, characters dropped.
FOLD_FROM = "\u2018\u2019\u201a\u201b\u201c\u201d\u201e\u2013\u2014\u2015\u2010\u2011\u2212\u00a0"
FOLD_TO = "'" * 4 + '"' * 3 + "-" * 6 + " "
FOLD_LONG = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("…", "..."))
DROPPED = "[\\x{F000}-\\x{F8FF}\\x{FFFD}'\"]+"
#: White space as Python's str.isspace() has it.
SPACE = "[\\x09-\\x0D\\x1C-\\x20\\x85\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
# Patterns of refusals and of reasoning blocks.
REFUSAL = (
    "(?i)(not (stated|specified|mentioned|given|provided|available|found)|does not (contain|specify|state|mention)|no (information|mention|answer)"
    "|cannot (be )?(found|determined)|unable to (find|determine)|isn't (stated|specified))")
EXPLICIT_REFUSAL = "(?i)^\\s*i (do not|don't) know"
CLOSED_BLOCK = "(?s)<think>.*?</think>"
EMPTY_BLOCK = "<think>[ \\t]*\\r?\\n[ \\t]*\\r?\\n"


def normalise_page(text: Column) -> Column:
    """Line ends lose spaces and tabs, three or more line feeds become two, edge line feeds go."""
    text = F.regexp_replace(text, "[ \\t]+(\\n|$)", "$1")
    return F.btrim(F.regexp_replace(text, "\\n{3,}", "\n\n"), F.lit("\n"))


def fold(text: Column) -> Column:
    """Dashes, quotes, no-break spaces, ligatures and the ellipsis in plain ASCII."""
    text = F.translate(text, FOLD_FROM, FOLD_TO)
    for one, many in FOLD_LONG:
        text = F.replace(text, F.lit(one), F.lit(many))
    return text


def plain(text: Column) -> Column:
    """Folded, without quotes, private-use characters and the replacement character."""
    return F.regexp_replace(fold(text), DROPPED, "")


def compact(text: Column) -> Column:
    """``plain`` in lower case without white space."""
    return F.regexp_replace(F.regexp_replace(F.lower(fold(text)), DROPPED, ""), SPACE, "")


def compact_map(text: Column) -> Column:
    """For each character of ``compact(text)`` the place in ``text``, from 0, of the one it comes from."""
    places = F.transform(F.split(text, ""), lambda c, k: F.array_repeat(k, F.length(compact(c))))
    return F.when(text == "", F.array().cast("array<int>")).otherwise(F.flatten(places))


#: Letters whose lower case holds an ASCII letter: the dotted capital I (with a mark that ends a token) and the Kelvin sign.
DOTTED, KELVIN = "\u0130", "\u212a"
_LETTERS = f"0-9A-Za-z{KELVIN}"


def token_pieces(text: Column) -> Column:
    """Each token of ``text`` with what stands before it since the last one, as it stands there.

    The tokens are those of ``tokens``, but the text is not lowered, as some letters grow in lower case.
    """
    return F.regexp_extract_all(text, F.lit(f"[^{_LETTERS}{DOTTED}]*(?:[{_LETTERS}]+{DOTTED}?|{DOTTED})"), F.lit(0))


def without_gap(piece: Column) -> Column:
    """Joined pieces without what stands before their first token."""
    return F.regexp_replace(piece, f"^[^{_LETTERS}{DOTTED}]+", "")


def spoken(passage: Column) -> Column:
    """The tokens of a passage of ``token_pieces``, joined by spaces: one pass over the passage."""
    passage = F.replace(F.replace(passage, F.lit(DOTTED), F.lit("i ")), F.lit(KELVIN), F.lit("k"))
    return F.lower(F.trim(F.regexp_replace(passage, "[^0-9A-Za-z]+", " ")))


def squash(text: Column) -> Column:
    """Runs of white space as one space, none at the edges."""
    return F.btrim(F.regexp_replace(text, SPACE, " "))


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[0-9a-z]+"), F.lit(0))


def nothing(text: Column) -> Column:
    """A text with null as empty."""
    return F.coalesce(text, F.lit(""))


def normalise_answer(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9 ]+", ""))


def number_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("[0-9]+(\\.[0-9]+)?"), F.lit(0))))


def clean_answer(text: Column) -> Column:
    """An answer without its reasoning.

    Closed think blocks go. An unclosed block that opens with a blank line is empty: it goes and its
    tail is the answer. The tail of any other unclosed block goes. Stray tags and edge white space go last.
    """
    text = F.regexp_replace(text, CLOSED_BLOCK, "")
    text = F.when(text.rlike(EMPTY_BLOCK), F.regexp_replace(text, EMPTY_BLOCK, "")).otherwise(F.regexp_replace(text, "(?s)<think>.*$", ""))
    text = F.regexp_replace(text, "</?think>", "")
    return F.regexp_replace(F.regexp_replace(text, "^" + SPACE, ""), SPACE + "$", "")


def thinking_tokens(text: Column) -> Column:
    """Tokens inside closed think blocks and in an unclosed, non-empty tail."""
    closed = F.array_join(F.regexp_extract_all(text, F.lit("(?s)<think>(.*?)</think>"), F.lit(1)), " ")
    rest = F.regexp_replace(text, CLOSED_BLOCK, "")
    tail = F.when(rest.rlike(EMPTY_BLOCK), "").otherwise(F.regexp_extract(rest, "(?s)<think>(.*)$", 1))
    return F.size(tokens(closed)) + F.size(tokens(tail))


def page_list(pages: Column) -> Column:
    """'29-31' and '2, 5, 7' as numbers; null and the text null give an empty list, blanks are skipped."""
    # A lambda: given a function of two parameters, transform would pass the place as the second, the characters to trim.
    parts = F.filter(F.transform(F.split(pages, ","), lambda p: F.trim(p)), lambda p: p != "")

    def span(p: Column) -> Column:
        low = F.split(p, "-")[0].cast("int")
        return F.sequence(low, F.coalesce(F.get(F.split(p, "-"), F.lit(1)).cast("int"), low))

    empty = F.array().cast("array<int>")
    return F.when(pages.isNull() | (pages == "null"), empty).otherwise(F.flatten(F.transform(parts, span)))


def doc_id_of(source: Column) -> Column:
    return F.lower(F.regexp_replace(source, "\\.[^.]*$", ""))


def redact(text: Column) -> Column:
    """Mail addresses, phone-like numbers and keys replaced by placeholders."""
    for pattern, name in REDACTED:
        text = F.regexp_replace(text, pattern, name)
    return text


# Patterns and their placeholders, in the order of replacement.
REDACTED = (
    ("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "<EMAIL>"),
    ("(AKIA|ASIA)[A-Z0-9]{16}", "<KEY>"),
    ("(sk|ghp|xoxb)[-_][A-Za-z0-9]{16,}", "<KEY>"),
    ("[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}", "<IP>"),
    ("\\+?[0-9]{1,3}[ -][(]?[0-9]{2,4}[)]?[ -][0-9]{3,4}[ -][0-9]{2,4}", "<PHONE>"),
)


def lenient_json(reply: Column) -> Column:
    """The JSON of a reply: the whole of it, else from its first bracket to the last one of that kind, so without what stands around; null if there is none."""
    bare = F.regexp_replace(F.regexp_replace(reply, "^" + SPACE, ""), SPACE + "$", "")
    block = F.regexp_extract(bare, "(?s)(\\[.*\\]|\\{.*\\})", 1)
    return F.when(F.try_parse_json(bare).isNotNull(), bare).when(block != "", block)


# Words read with l for I, and brackets inside words.
SCAN_MARKS = ("\\b(lf|ln|lt|lssue|ls)\\b", "[a-z][\\]\\[\\\\|]{1,2}[a-z]")


def bad_scan_marks(text: Column) -> Column:
    """Marks of bad character recognition."""
    return F.regexp_count(text, F.lit(SCAN_MARKS[0])) + F.regexp_count(text, F.lit(SCAN_MARKS[1]))
