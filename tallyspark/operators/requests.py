"""Validation of filter requests that arrive as a table.

Input: ``request_id, consulta, valor`` and, if known, ``valor_tipo`` (the JSON
type the value had). The rules are those of ``FilterSpec``, as column
expressions, so any number of requests is validated in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.contract import CHANNELS, FILTER_NAMES, GENDERS, REQUEST_SCHEMA
from tallyspark.functions.moments import add_boundary, is_whole_day
from tallyspark.functions.text import INTEGER, WHITE_SPACE, ascii_digits, strip
from tallyspark.operators.batch import REQUEST_ID
from tallyspark.operators.filters import INTEGER_RANGES, MAX_DIGITS

_PYTHON_SPACE = WHITE_SPACE + "\x1c\x1d\x1e\x1f"
_DATES = ("FECHA_DESDE", "FECHA_HASTA")
SALTS = 16
_DOTLESS_I = "\u0131"  # the one letter that only upper case makes an ASCII one
_HEX_HEAD = r"^\+?(?:0x_?)?"
_HEX_NUMBER = _HEX_HEAD + r"[0-9a-f]+(?:_[0-9a-f]+)*\z"


def _one_of(allowed: tuple[str, ...], text: Column, fold) -> Column:
    chain = F
    for value in allowed:
        chain = chain.when(text == fold(value), F.lit(value))
    return chain.otherwise(F.lit(None).cast("string"))


def _case_folded(text: Column) -> Column:
    """Upper case, which also brings a long s or a ligature to its plain letters."""
    return F.when(~F.contains(text, F.lit(_DOTLESS_I)), F.upper(text))


def _add_uuid(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Add the canonical UUID of a stripped text: 32 characters without the decoration.

    They are read as one hexadecimal number, so a plus sign, ``0x``, single underscores
    and digits of any script may stand among them.
    """
    source = F.col(text)
    bare = F.replace(F.replace(source, F.lit("urn:"), F.lit("")), F.lit("uuid:"), F.lit(""))
    body, number = F.col("__body"), F.col("__number")
    digits = F.lpad(F.replace(F.regexp_replace(number, _HEX_HEAD, ""), F.lit("_"), F.lit("")), 32, "0")
    parts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    joined = F.concat_ws("-", *(F.substring("__digits", start, size) for start, size in parts))
    return (
        rows.withColumn("__body", F.replace(F.btrim(bare, F.lit("{}")), F.lit("-"), F.lit("")))
        .withColumn("__number", F.lower(ascii_digits(strip(body))))
        .withColumn("__digits", digits)
        .withColumn(name, F.when((F.length(body) == 32) & number.rlike(_HEX_NUMBER), joined))
        .drop("__body", "__number", "__digits")
    )


def validate_requests(pairs: DataFrame) -> DataFrame:
    """Every pair with ``valor_norm``, ``instante``, ``exclusiva`` and ``error_code``.

    ``error_code`` is null for a good pair. ``valor_norm`` is canonical text;
    the two date filters give ``instante`` (UTC) instead of it.
    """
    kind = F.col("valor_tipo") if "valor_tipo" in pairs.columns else F.lit("string")
    name, text = F.col("consulta"), F.col("__text")
    is_text = F.col("__kind") == "string"
    is_integer_type = F.col("__kind").isin("string", "integer")
    is_date = name.isin(*_DATES)
    base = pairs.select(
        REQUEST_ID,
        "consulta",
        "valor",
        F.btrim("valor", F.lit(_PYTHON_SPACE)).alias("__text"),
        F.coalesce(kind, F.lit("string")).alias("__kind"),
    )
    # ASCII zeros in front do not count; digits of other scripts do, zeros included.
    digits = F.ltrim(F.regexp_replace(text, r"^[+-]", ""), F.lit("0"))
    parsed = (
        base.withColumn("__digits", F.when(F.length(digits) <= MAX_DIGITS, ascii_digits(digits)))
        .withColumns(
            {
                "__whole": F.when(
                    F.concat(F.lit("0"), "__digits").rlike(INTEGER) & (text != "") & ~text.isin("+", "-"),
                    F.concat(
                        F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit("")),
                        F.lit("0"),
                        "__digits",
                    ).try_cast("decimal(20,0)"),
                ),
                "__gender": _one_of(GENDERS, _case_folded(text), str.upper),
                "__channel": _one_of(CHANNELS, F.upper(text), str.upper),
                "__date": F.when(is_date & is_text, text),
            }
        )
    )
    parsed = _add_uuid(parsed, "__text", "__person")
    parsed = add_boundary(parsed, "__date", name == "FECHA_HASTA", "instante")

    whole = F.col("__whole")
    in_range = F.lit(False)
    for filter_name, (smallest, largest) in INTEGER_RANGES.items():
        in_range = in_range | ((name == filter_name) & whole.between(smallest, largest))
    is_number = name.isin(*INTEGER_RANGES)
    own_error = (
        F.when(name.isNull() | ~name.isin(*FILTER_NAMES), "unknown_filter")
        .when(F.col("valor").isNull() | (F.col("__kind") == "null"), "missing_value")
        .when(is_number & (~is_integer_type | whole.isNull()), "not_integer")
        .when(is_number & ~in_range, "out_of_range")
        .when(is_date & F.col("instante").isNull(), "not_iso_date")
        .when(~is_number & ~is_date & ~is_text, "not_text")
        .when((name == "GENERO") & F.col("__gender").isNull(), "unknown_gender")
        .when((name == "CANAL") & F.col("__channel").isNull(), "unknown_channel")
        .when((name == "ID_PERSONA") & F.col("__person").isNull(), "not_uuid")
    )
    checked = parsed.withColumn("__own", own_error).select(
        REQUEST_ID,
        "consulta",
        "valor",
        F.when(
            F.col("__own").isNull(),
            F.when(is_number, whole.cast("string"))
            .when(name == "GENERO", F.col("__gender"))
            .when(name == "CANAL", F.col("__channel"))
            .when(name == "ID_PERSONA", F.col("__person")),
        ).alias("valor_norm"),
        "instante",
        F.when(
            is_date & F.col("instante").isNotNull(), (name == "FECHA_HASTA") & is_whole_day(text)
        ).alias("exclusiva"),
        "__own",
    )

    # What concerns a whole request comes from one partial aggregate, and only the
    # requests with a fault go on to the join. A request id that holds very many
    # pairs (it repeats filters then) is one row there, and its pairs are salted.
    start = F.when(name == "FECHA_DESDE", F.col("instante"))
    end = F.when(name == "FECHA_HASTA", F.col("instante"))
    open_end = F.bool_or((name == "FECHA_HASTA") & F.col("exclusiva"))
    late = (F.max(start) > F.min(end)) | (open_end & (F.max(start) == F.min(end)))
    repeated = F.filter(
        F.array(*(F.when(F.count_if(name == n) > 1, F.lit(n)) for n in FILTER_NAMES)),
        lambda filter_name: filter_name.isNotNull(),
    )
    faults = (
        checked.groupBy(REQUEST_ID)
        .agg(repeated.alias("__repeated"), F.coalesce(late, F.lit(False)).alias("__late"))
        .where(F.col("__late") | (F.size("__repeated") > 0))
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    salted = checked.withColumn(
        "__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    )
    return salted.join(faults, [REQUEST_ID, "__salt"], "left").select(
        REQUEST_ID,
        "consulta",
        "valor",
        "valor_norm",
        "instante",
        "exclusiva",
        F.when(F.col("__own") == "unknown_filter", F.col("__own"))
        .when(F.array_contains("__repeated", name), "repeated_filter")
        .otherwise(F.coalesce("__own", F.when(is_date & F.col("__late"), "reversed_range")))
        .alias("error_code"),
    )


def accepted_requests(validated: DataFrame) -> DataFrame:
    """Typed request rows (for ``batch_statistics``) of the requests without any error."""
    name = F.col("consulta")

    def value(filter_name: str) -> Column:
        return F.max(F.when(name == filter_name, F.col("valor_norm")))

    columns = {
        "genero": value("GENERO"),
        "edad": value("EDAD"),
        "canal": value("CANAL"),
        "codigo_producto": value("CODIGO_PRODUCTO"),
        "id_persona": value("ID_PERSONA"),
        "local": value("LOCAL"),
        "fecha_desde": F.max(F.when(name == "FECHA_DESDE", F.col("instante"))),
        "fecha_hasta": F.max(F.when(name == "FECHA_HASTA", F.col("instante"))),
        "fecha_hasta_exclusiva": F.coalesce(
            F.bool_or(F.when(name == "FECHA_HASTA", F.col("exclusiva"))), F.lit(False)
        ),
    }
    return (
        validated.groupBy(REQUEST_ID)
        .agg(
            F.count("error_code").alias("__errors"),
            *(
                columns[field.name].cast(field.dataType).alias(field.name)
                for field in REQUEST_SCHEMA.fields
            ),
        )
        .where(F.col("__errors") == 0)
        .drop("__errors")
    )
