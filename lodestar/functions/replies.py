"""Parsers of model replies, as Column expressions on the reply text.

A null reply stands for a failed call everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.text import once, strip

# fixed values: the sentence of abstention, the labels and the pattern of a grade
NO_ANSWER = "O contexto fornecido não contém informação suficiente para responder."
SUPPORT_LABELS = {
    "fully": "totalmente sustentada",
    "partially": "parcialmente sustentada",
    "no_support": "sem respaldo no contexto",
}
DEFAULT_GRADE = 5.0
GRADE = r"\b(10|[0-9])(?:[.,](\d+))?\b"


def clean_lines(reply: Column) -> Column:
    """Lines without numbering, bullets and enclosing quotes; empty ones left out."""

    def clean(line: Column) -> Column:
        bare = F.regexp_replace(strip(line), r"^\s*(\d+[.)]|[-*•])\s*", "")
        unquoted = F.regexp_replace(F.regexp_replace(strip(bare), r'^"+|"+$', ""), r"^'+|'+$", "")
        return strip(unquoted)

    return F.filter(F.transform(F.split(F.coalesce(reply, F.lit("")), r"\r\n|[\n\r]"), clean), lambda x: x != "")


def grade(reply: Column) -> Column:
    """The first number from 0 to 10, with decimals after a point or comma; null if none."""
    whole = F.regexp_extract(reply, GRADE, 1)
    part = F.regexp_extract(reply, GRADE, 2)
    value = F.concat(whole, F.lit("."), F.when(part == "", F.lit("0")).otherwise(part)).try_cast("double")
    return F.when(whole != "", F.least(F.lit(10.0), F.greatest(F.lit(0.0), value)))


def listed_order(reply: Column, n: Column) -> Column:
    """1..n as the reply ranks them: in range, first mention only, the rest in their order."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(reply, F.lit("")), F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("int"))
    named = F.array_distinct(F.filter(numbers, lambda x: x.isNotNull() & (x >= 1) & (x <= n)))
    return once(named, lambda x: F.concat(x, F.array_except(F.sequence(F.lit(1), n), x)))


def json_object(reply: Column) -> Column:
    """The text from the first { to the last }, null if there is none or it is not JSON."""
    found = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)\{.*\}", 0)
    return F.when((found != "") & F.json_object_keys(found).isNotNull(), found)


def has_key(obj: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(obj), key), F.lit(False))


def truthy(obj: Column, key: str) -> Column:
    """Whether a JSON value counts as true: any non-empty string does, "false" too."""
    raw = F.get_json_object(obj, f"$.{key}")
    # the value's first character tells strings from literals
    quoted = F.regexp_extract(obj, rf'"{key}"\s*:\s*(.)', 1) == '"'
    empty = raw.isNull() | F.when(quoted, raw == "").otherwise(raw.isin("false", "null", "", "[]", "{}") | (raw.try_cast("double") == 0))
    return ~F.coalesce(empty, F.lit(False))


def is_relevant(reply: Column) -> Column:
    """IsREL: the JSON verdict, else whether the reply says true; kept on failure."""
    raw = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)\{.*\}", 0)
    obj = json_object(reply)
    verdict = F.when(has_key(obj, "relevante"), truthy(obj, "relevante")).otherwise(F.lit(True))
    said = F.contains(F.lower(reply), F.lit("true"))
    return F.when(reply.isNull(), F.lit(True)).when(raw != "", verdict).otherwise(said)


def should_retrieve(reply: Column) -> Column:
    """Retrieve decision: true when the key is missing or the call failed."""
    obj = json_object(reply)
    return F.when(has_key(obj, "recuperar"), truthy(obj, "recuperar")).otherwise(F.lit(True))


def critique(reply: Column, n_hits: Column) -> Column:
    """struct(support, utility, claims, comment) with the values made valid."""
    obj = json_object(reply)
    some = F.coalesce(F.size(F.json_object_keys(obj)) > 0, F.lit(False))
    support = F.lower(F.coalesce(F.get_json_object(obj, "$.suporte"), F.lit("partially")))
    number = F.get_json_object(obj, "$.utilidade")
    # a quoted number must be whole to count; a bare one is cut to its whole part
    quoted = F.regexp_extract(obj, r'"utilidade"\s*:\s*(.)', 1) == '"'
    whole = F.when(quoted, strip(number).try_cast("int")).otherwise(
        F.when(number == "true", F.lit(1)).when(number == "false", F.lit(0)).otherwise(number.try_cast("double").try_cast("int"))
    )
    utility = F.coalesce(F.greatest(F.lit(1), F.least(F.lit(5), whole)), F.lit(3))
    claims = F.coalesce(
        F.from_json(F.get_json_object(obj, "$.afirmacoes_sem_respaldo"), "array<string>"), F.array().cast("array<string>")
    )
    none = F.array().cast("array<string>")

    def made(s, u, c, m):
        return F.struct(s.alias("support"), u.alias("utility"), c.alias("claims"), m.alias("comment"))

    given = made(
        F.when(support.isin("fully", "partially", "no_support"), support).otherwise(F.lit("partially")), utility,
        F.slice(claims, 1, 5), F.coalesce(F.get_json_object(obj, "$.comentario"), F.lit("")),
    )
    return (
        F.when(n_hits == 0, made(F.lit("no_support"), F.lit(1), none, F.lit("no context retrieved")))
        .when(reply.isNull(), made(F.lit("partially"), F.lit(3), none, F.lit("critique failed")))
        .when(~some, made(F.lit("partially"), F.lit(3), none, F.lit("critique not readable")))
        .otherwise(given)
    )


def trusted(c: Column) -> Column:
    return (c["support"] == "fully") & (c["utility"] >= 4)


def support_label(support: Column) -> Column:
    out = support
    for value, label in SUPPORT_LABELS.items():
        out = F.when(support == value, F.lit(label)).otherwise(out)
    return out


def annotated(answer: Column, c: Column) -> Column:
    """The answer, with a caveat below it when the critique does not trust it.

    The caveat's wording and the keys of a reply are fixed values."""
    head = F.concat(
        F.lit("\n---\nRessalva da auto-avaliação: resposta "), support_label(c["support"]),
        F.lit(" (utilidade "), c["utility"].cast("string"), F.lit("/5)."),
    )
    claims = F.when(
        F.size(c["claims"]) > 0,
        F.concat(
            F.lit("\nAfirmações sem respaldo direto no contexto recuperado:\n"),
            F.array_join(F.transform(c["claims"], lambda x: F.concat(F.lit("  - "), x)), "\n"),
        ),
    ).otherwise(F.lit(""))
    return F.when(trusted(c), answer).otherwise(F.concat(answer, head, claims))


def abstains(answer: Column) -> Column:
    """Whether the answer holds the fixed sentence of having no answer, in any case."""
    return F.contains(F.lower(F.coalesce(answer, F.lit(""))), F.lower(F.lit(NO_ANSWER)))
