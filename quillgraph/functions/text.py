"""Text functions as Column expressions.  White space, digits and word borders are Unicode's, as `(?U)` asks of Java."""

from __future__ import annotations

from collections.abc import Callable
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles, reference patterns, caption labels, prefixes of model output, and their limits.
SECTION_NUMBER = r"(?U)^(\d+\.?\d*\.?\d*)\s+(.+)$"
SECTION_TITLES = ("abstract", "introduction", "conclusion", "related work", "background", "discussion", "acknowledgment", "acknowledgements", "references")
REFERENCES = {
    "Figure": r"(?iU)\b(?:Fig(?:ure)?s?\.?\s*|fig(?:ure)?s?\.?\s*)(\d+[a-zA-Z]?)\b",
    "Table": r"(?iU)\b(?:Tab(?:le)?s?\.?\s*)(\d+[a-zA-Z]?)\b",
    "Equation": r"(?iU)\b(?:Eq(?:uation)?s?\.?\s*\(?|eq\.\s*\(?)(\d+)\b",
}
KOREAN_REFERENCES = {
    "Figure": r"(?U)(?:그림|사진|도표|도)\s*(\d+[a-zA-Z]?)",
    "Table": r"(?U)(?:표|테이블)\s*(\d+[a-zA-Z]?)",
    "Equation": r"(?U)(?:식|수식|방정식)\s*\(?(\d+)\)?",
}
KOREAN_AUGMENTATION = {
    "Figure": r"(?U)(?:그\s?림|사진|도표|도해)\s*[<\[(]?\s*(\d+)",
    "Table": r"(?U)(?:표|테이블)\s*[<\[(]?\s*(\d+)",
    "Equation": r"(?U)(?:식|수식)\s*[<\[(]?\s*(\d+)",
}
CAPTION_LABEL = r"(?iU)^\s*[<〈\[【(]?\s*(Fig(?:ure)?\.?|Table|그\s?림|표|사진|도표|수식|식)\s*\.?\s*(\d+(?:[-.]\d+)?)?\s*[>〉\]】)]?\s*[.:、,]?\s*"
LABEL_KINDS = {
    "fig": "figure", "fig.": "figure", "figure": "figure", "figure.": "figure", "그림": "figure", "그 림": "figure", "사진": "figure", "도표": "figure",
    "table": "table", "표": "table",
    "수식": "equation", "식": "equation",
}
CONTENT_WORD = r"[가-힣]{2,}|[A-Za-z]{4,}|\d+(?:\.\d+)?"
QUESTION_PREFIX = r"(?iU)^\s*(?:\*\*)?\s*(?:질문|문제|Question|Q)\s*(?:\d+)?\s*[:：.)\]]\s*"
ANSWER_PREFIX = r"(?iU)^\s*(?:\*\*)?\s*(?:답변|답|Answer|A)\s*[:：.)\]]\s*"
BULLET = r"(?U)^\s*(?:\d+\s*[.)]|[-*•])\s*"
FENCE = r"(?U)^```[a-zA-Z]*\s*|\s*```$"
QUESTION_LENGTH, ANSWER_LENGTH, GOLD_LENGTH = (6, 400), 2, (2, 200)
HANGUL_RATIO, LANGUAGE_LETTERS, LANGUAGE_CHARS = 0.15, 50, 6000
RELATIONS = ("ILLUSTRATES", "SUPPORTS", "QUANTIFIES", "COMPARES", "CONTRADICTS", "DERIVES_FROM")


#: What `\s` matches under (?U).
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """By characters, not by a pattern, which would try each run of white space within the text."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def squeeze(c: Column) -> Column:
    """Runs of white space become one space, none at the ends; also the key by which texts count as the same."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))  # after it a space is the only white space


def strip_chars(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, which is worked out once for a row however often f names it: expressions that hold lambdas are not shared by the engine."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def in_pieces(c: Column, size: int, more: int) -> Column:
    """A text in pieces of `size` characters, each with the first `more` (at most `size`) of the next one; an empty text is one piece.

    The text is passed over once, whereas a substring for each piece would begin at its start each time; a look-ahead takes
    a piece with what follows it.
    """
    t = text(c)
    return F.when(t == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{1,{size + more}}})).{{1,{size}}}"), F.lit(1)))


def has_text(c: Column) -> Column:
    return strip(text(c)) != ""


def is_section_title(content: Column) -> Column:
    """A numbered line, one of the usual titles, or a short line in capitals."""
    return is_title(strip(text(content)))


def is_title(t: Column) -> Column:
    """The same of a text that is stripped already."""
    capitals = (F.upper(t) == t) & (F.lower(t) != t) & (F.length(t) < 60)
    return t.rlike(SECTION_NUMBER) | F.lower(t).isin(*SECTION_TITLES) | capitals


def section_depth(content: Column) -> Column:
    number = F.regexp_extract(strip(text(content)), SECTION_NUMBER, 1)
    return F.when(number != "", F.length(number) - F.length(F.replace(number, F.lit("."))) + 1).otherwise(1).cast("int")


def references(content: Column, kind: str, korean: bool = False) -> Column:
    """The numbers of the figures, tables or equations that a text mentions; mentions are repeated."""
    found = F.regexp_extract_all(text(content), F.lit(REFERENCES[kind]), F.lit(1))
    if korean:
        found = F.concat(found, F.regexp_extract_all(text(content), F.lit(KOREAN_REFERENCES[kind]), F.lit(1)))
    return found


def clean_content(content: Column, longest: int = 0) -> Column:
    """Plain text; the cells of an HTML table are kept apart by bars and its rows by lines."""
    t = strip(text(content))
    cells = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"(?U)</t[dh]>\s*", " | "), r"(?U)</tr>\s*", "\n"), r"<[^>]+>", " ")
    lines = F.transform(F.split(cells, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: strip(strip_chars(F.regexp_replace(x, r"(?U)\s+", " "), " |")))
    table = F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    out = F.when(t.contains("<") & t.contains(">"), table).otherwise(squeeze(t))
    return shortened(out, longest) if longest else out


def shortened(t: Column, longest: int) -> Column:
    return F.when(F.length(t) > longest, F.concat(F.substring(t, 1, longest), F.lit("…"))).otherwise(t)


def language(sample: Column) -> Column:
    """ko, en or unknown, from the share of Hangul among the letters of a text's beginning."""
    t = F.substring(text(sample), 1, LANGUAGE_CHARS)
    letters, hangul = F.regexp_count(t, F.lit("[A-Za-z가-힣]")), F.regexp_count(t, F.lit("[가-힣]"))
    return F.when(letters < LANGUAGE_LETTERS, "unknown").when(hangul / letters >= HANGUL_RATIO, "ko").otherwise("en")


def particle(word: Column, with_final: str, without_final: str) -> Column:
    """The Korean particle that fits a word: by the final consonant of its last syllable."""
    last = F.right(word, F.lit(1))
    final = last.between("가", "힣") & (F.pmod(F.ascii(last) - 44032, F.lit(28)) != 0)
    return F.when(final, with_final).otherwise(without_final)


def label_kind(caption: Column) -> Column:
    """What kind of thing the label at the start of a caption names, or null."""
    kind = F.lower(strip(F.regexp_extract(text(caption), CAPTION_LABEL, 1)))
    pairs = [x for k, v in LABEL_KINDS.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), kind)


def strip_caption_label(caption: Column) -> Column:
    rest = strip(F.regexp_replace(text(caption), CAPTION_LABEL, ""))
    return F.when(rest != "", rest).otherwise(strip(text(caption)))


def is_usable_gold(gold: Column, require_hangul: bool = True) -> Column:
    usable = text(gold).rlike(CONTENT_WORD)
    return usable & text(gold).rlike("[가-힣]") if require_hangul else usable


def clean_question(raw: Column) -> Column:
    """The question in a model's output: without fences, prefixes, bullets and quotes; with options if it has any."""
    t = F.regexp_replace(strip(F.regexp_replace(strip(text(raw)), FENCE, "")), r"\*\*(.+?)\*\*", "$1")
    lines = F.filter(F.transform(F.split(t, r"\r\n|\n|\r"), strip), lambda x: x != "")
    return once(once(lines, _question), lambda x: F.when(F.length(x).between(*QUESTION_LENGTH), x).otherwise(""))


def _question(lines: Column) -> Column:
    plain = lambda x: F.regexp_replace(F.regexp_replace(x, QUESTION_PREFIX, ""), BULLET, "")
    stop = F.array_position(F.transform(lines, lambda x: x.rlike(r"(?iU)^(?:정답|Answer)\s*[:：]")), True)
    kept = once(stop, lambda at: F.when(at > 0, F.slice(lines, F.lit(1), (at - 1).cast("int"))).otherwise(lines))
    many = strip(F.array_join(F.transform(kept, plain), "\n"))
    one = strip(plain(F.get(lines, F.lit(0))))
    t = F.when(F.exists(lines, lambda x: x.rlike(r"^[A-D]\)")), many).otherwise(F.coalesce(one, F.lit("")))
    return strip(strip_chars(strip_chars(strip_chars(strip(t), '"'), "'"), "「」"))


def clean_answer(raw: Column) -> Column:
    t = strip(F.regexp_replace(strip(text(raw)), FENCE, ""))
    t = strip(strip_chars(strip_chars(strip(F.regexp_replace(t, ANSWER_PREFIX, "")), '"'), "'"))
    return once(t, lambda x: F.when(F.length(x) < ANSWER_LENGTH, "").otherwise(x))


def relation(response: Column) -> Column:
    """The first relation that a model's response names, ILLUSTRATES by default."""
    out = F.lit("ILLUSTRATES")
    for name in reversed(RELATIONS):
        out = F.when(F.upper(text(response)).contains(name), name).otherwise(out)
    return out


def concept_lines(response: Column, most: int = 3) -> Column:
    """The first lines of a model's response that are long enough, without bullets."""
    lines = F.filter(F.split(text(response), "\n"), lambda x: F.length(strip(x)) > 5)
    return F.slice(F.transform(lines, lambda x: strip_chars(x, " \\-•*")), 1, most)


def enriched(caption: Column, description: Column) -> Column:
    return F.when(has_text(description), F.concat(text(caption), F.lit("\n[VLM]: "), description)).otherwise(text(caption))


def names_in(template: str) -> list[str]:
    """The {names} of a template, in their order; {{ and }} are braces."""
    return [name for _, name, _, _ in Formatter().parse(template) if name is not None]


def fill(template: str, values: dict[str, Column], missing: Column | None = None) -> Column:
    """A template with its {names} replaced, all at once: what a value says is never taken for a name.

    A name without a value is a KeyError, unless `missing` is to stand for it.
    """
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            if name not in values and missing is None:
                raise KeyError(name)
            parts.append(values.get(name, missing))
    return F.concat(*parts) if parts else F.lit("")


def fill_by(key: Column, templates: dict[str, str], default: str, values: dict[str, Column]) -> Column:
    """The template that a key names, or the one named `default`, filled."""
    out = fill(templates[default], values)
    for name, template in templates.items():
        if name != default:
            out = F.when(key == name, fill(template, values)).otherwise(out)
    return out
