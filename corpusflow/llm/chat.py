"""Chat formatting with typed content parts, in built-in column functions.

A turn holds parts: text, image, audio, document. A visitor turns each into text: text is escaped, everything else becomes a
placeholder that names the turn and the part, is listed as an attachment, and counts as the tokens it expands to.
Turns stand between ``<turn role>`` and ``</turn>``. In texts and roles a backslash is written ``\\\\``, ``<`` as ``\\l`` and
``>`` as ``\\g``, so that no text can hold a mark of the template, and reading back gives every text exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens per unit: an image's units are its tiles, an audio's its seconds, a document's its pages.
TOKENS_PER_UNIT = {"image": 256.0, "audio": 25.0, "document": 600.0}
_OPEN, _CLOSE = "<turn ", "</turn>\n"


def escape(column: str) -> str:
    return rf"replace(replace(replace({column}, '\\', '\\\\'), '<', '\\l'), '>', '\\g')"


def unescape(column: str) -> str:
    """SQL: escaped backslashes come in pairs, so cutting at pairs keeps them apart from other escapes."""
    return (
        rf"array_join(transform(split({column}, '\\\\\\\\', -1),"
        r" x -> replace(replace(x, '\\l', '<'), '\\g', '>')), '\\')"
    )


def text_turns(conversations: DataFrame) -> DataFrame:
    """Rows of conv_id, turn, role and text as turns with a single text part."""
    part = F.struct(
        F.lit("text").alias("kind"),
        F.col("text"),
        F.lit(None).cast("string").alias("uri"),
        F.lit(None).cast("double").alias("units"),
    )
    return conversations.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def _visited(tokens_per_unit: dict[str, float]) -> tuple[Column, Column]:
    """The text of a turn, and its attachments."""
    rates = "map(" + ", ".join(f"'{k}', {float(v)!r}D" for k, v in sorted(tokens_per_unit.items())) + ")"
    parts = "filter(coalesce(parts, array()), p -> p is not null)"
    kind = "coalesce(p.kind, 'unknown')"
    body = (
        f"array_join(transform({parts}, (p, i) -> case when {kind} = 'text' then {escape("coalesce(p.text, '')")}"
        f" else concat('<', {escape(kind)}, ' ', cast(n as string), '.', cast(i + 1 as string), '>') end), '')"
    )
    listed = (
        f"filter(transform({parts}, (p, i) -> named_struct('turn', n, 'part', i + 1, 'kind', {kind}, 'uri', p.uri,"
        f" 'tokens', cast(ceil(coalesce(p.units, 1D) * coalesce(try_element_at({rates}, {kind}), 0D)) as long))),"
        " a -> a.kind <> 'text')"
    )
    return F.expr(body), F.expr(listed)


def format_conversations(
    turns: DataFrame, tokens_per_unit: dict[str, float] | None = None, learned: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """A row per conversation: ``conv_id, formatted, loss`` (start and length in ``formatted``), ``attachments``,
    ``attachment_tokens``.

    ``turns``: conv_id, turn, role, parts (array of kind, text, uri, units), other columns ignored. Turns go by ``turn``,
    nulls first, ties by role and content; equal rows stay. A null role is empty, null texts and parts are empty, units
    default to one. Kinds without a rate count no tokens. Rows with a null conv_id form one conversation. ``learned``
    names the roles whose content is under the loss mask.
    """
    body, listed = _visited(TOKENS_PER_UNIT if tokens_per_unit is None else tokens_per_unit)
    key = Window.partitionBy("conv_id").orderBy("turn", "role", F.to_json("parts"))
    numbered = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), "parts"
    ).withColumn("n", F.row_number().over(key))
    pieces = numbered.withColumn("body", body).withColumn("attached", listed).withColumn(
        "head", F.concat(F.lit(_OPEN), F.expr(escape("role")), F.lit(">\n"))
    )
    size = F.length("head") + F.length("body") + len(_CLOSE)
    before = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head"))
    rows = placed.groupBy("conv_id").agg(
        F.array_sort(
            F.collect_list(F.struct("n", "head", "body", "at", F.col("role").isin(*learned).alias("learn"), "attached"))
        ).alias("t")
    )
    return rows.select(
        "conv_id",
        F.expr(f"array_join(transform(t, x -> concat(x.head, x.body, '{_CLOSE.strip()}\\n')), '')").alias("formatted"),
        F.expr(
            "transform(filter(t, x -> x.learn), x -> named_struct('start', x.at, 'chars', cast(length(x.body) as long)))"
        ).alias("loss"),
        F.expr("flatten(transform(t, x -> x.attached))").alias("attachments"),
    ).withColumn("attachment_tokens", F.expr("aggregate(attachments, 0L, (a, x) -> a + x.tokens)"))


def read_turns(formatted: str = "formatted") -> Column:
    """``role, text`` of each turn, read from a formatted conversation; placeholders stay in the text."""
    piece = f"filter(split({formatted}, '</turn>\\n', -1), x -> x <> '')"
    head = f"length('{_OPEN}')"
    return F.expr(
        f"transform({piece}, x -> named_struct("
        f"'role', {unescape(f"substring(x, {head} + 1, locate('>', x) - {head} - 1)")},"
        f" 'text', {unescape("substring(x, locate('>', x) + 2)")}))"
    )


def read_loss(formatted: str = "formatted", loss: str = "loss") -> Column:
    """The texts under the loss mask, cut out of a formatted conversation."""
    cut = f"substring({formatted}, cast(s.start as int) + 1, cast(s.chars as int))"
    return F.expr(f"transform({loss}, s -> {unescape(cut)})")
