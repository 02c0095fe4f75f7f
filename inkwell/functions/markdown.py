"""Column expressions over Markdown text and its front matter. All of them give null for null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.urls import _col

_FRONT = r"(?s)^---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)"


def squeeze_newlines(text: Column | str) -> Column:
    """No more than one blank line in a row, none at the ends."""
    return F.regexp_replace(F.regexp_replace(_col(text), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def with_front_matter(markdown: Column | str, source_url: Column | str, target_version: Column | str, collected_at: Column, title: Column | str | None = None) -> Column:
    """Front matter and body. collected_at is a timestamp that the caller gives, so that reruns agree."""
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\n"))
    parts = [F.lit("---\n"), line("source_url", _col(source_url))]
    if title is not None:
        parts.append(line("title", F.concat(F.lit('"'), _col(title), F.lit('"'))))
    parts += [line("target_version", _col(target_version)), line("collected_at", F.date_format(collected_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")), F.lit("---\n\n")]
    return F.concat(*parts, _col(markdown))


def front_matter(text: Column | str) -> Column:
    """The block between the opening and closing dashes, empty where there is none."""
    return F.regexp_extract(_col(text), _FRONT, 1)


def front_matter_body(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(text), _FRONT, ""), r"^\s+|\s+$", "")


def front_matter_value(text: Column | str, key: str) -> Column:
    """The value of a key of flat front matter as text (numbers unchanged, outer quotes cut), null where it is missing."""
    line = F.regexp_extract(front_matter(text), rf"(?m)^{key}[ \t]*:[ \t]*(.*?)[ \t]*\r?$", 1)
    quoted = F.regexp_extract(line, r"^([\"'])(.*)\1$", 2)
    return F.when(F.rlike(front_matter(text), F.lit(rf"(?m)^{key}[ \t]*:")), F.when(quoted != "", quoted).when(F.rlike(line, F.lit("^(\"\"|'')$")), F.lit("")).otherwise(line))


def file_stem(path: Column | str) -> Column:
    name = F.regexp_extract(_col(path), r"([^/\\]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


#: A role by the markup's public grammar: a name of letters and digits with single signs inside, maybe with a domain
#: before it, between colons; then its argument, in backquotes or, where converters have dropped these, up to white space.
ROLE = r"(?<![\w:]):[A-Za-z](?:[.+_:-]?[A-Za-z0-9])*:(?:`[^`]+`|(?![\s:`])\S+)"

# What the two linking roles point at, entities that are decoded, endings of source files.
SETTINGS_PAGE = "ref/settings/"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&amp;": "&"}
SOURCE_ENDINGS = r"\.(?:txt|rst)$"


def clean_roles(text: Column | str, base_url: str) -> Column:
    """Documentation roles left in converted text become plain Markdown: a doc role a link to its page, a setting role a
    link to the setting's anchor, any other role its argument with its backquotes. Then tildes and escapes before
    underscores and asterisks go, entities are decoded and blank lines squeezed.

    The text is cut at the roles, and each role, a piece of its own, is judged by its name."""

    def shown(piece: Column) -> Column:
        argument = F.regexp_replace(piece, r"^:(?:[^:`\s]+:)+", "")
        name = F.element_at(F.split(F.regexp_extract(piece, r"^:((?:[^:`\s]+:)+)", 1), ":"), -2)
        inner = F.btrim(argument, F.lit("`"))
        target = F.regexp_extract(inner, r"<([^<>]+)>\s*$", 1)
        title = F.when(target == "", inner).otherwise(F.btrim(F.regexp_replace(inner, r"<[^<>]+>\s*$", "")))
        page = F.btrim(F.regexp_replace(F.when(target == "", inner).otherwise(target), SOURCE_ENDINGS, ""), F.lit("/"))
        anchor = F.concat(F.lit(f"{SETTINGS_PAGE}#"), F.lower(F.replace(inner, F.lit("_"), F.lit("-"))))
        to = lambda words, where: F.concat(F.lit("["), words, F.lit(f"]({base_url}/"), where, F.lit(")"))
        return F.when(name == "doc", to(title, F.concat(page, F.lit("/")))).when(name == "setting", to(inner, anchor)).otherwise(argument)

    plain = _col(text)
    for written, char in ENTITIES.items():
        plain = F.replace(plain, F.lit(written), F.lit(char))
    plain = F.regexp_replace(plain, r"~|\\(?=[_*])", "")
    roles = F.transform(F.regexp_extract_all(plain, F.lit(ROLE), F.lit(0)), shown)
    pieces = F.zip_with(F.split(plain, ROLE, -1), roles, lambda between, role: F.concat(between, F.coalesce(role, F.lit(""))))
    return squeeze_newlines(F.array_join(pieces, ""))


def word_count(text: Column | str) -> Column:
    """Number of words between white space."""
    return F.regexp_count(_col(text), F.lit(r"\S+"))
