"""Ingest of form-shaped input.

S4 turns a document with parallel arrays (product ids, quantities, prices as
text) into line rows; S5 cleans person-like records; S6 splits records into
accepted and rejected with a reason.  All of it is per-row expressions
(``arrays_zip``/``posexplode``/``try_cast``), no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotline.schemas import MONEY

#: Texts without which a dimension row is refused.
REQUIRED_TEXT = {"product": ("product_name", "category"), "warehouse": ("warehouse_name", "location")}

#: Form fields by table: trimmed texts, texts that turn NULL when blank, and numbers that do.
FORM_TEXT = {"supplier": ("supplier_name", "location", "phone_number", "email"), "branch": ("branch_name", "location", "phone_number"),
             "employee": ("employee_name", "phone_number"), "customer": ("customer_name", "phone_number")}
FORM_OPTIONAL = {"employee": ("position",), "customer": ("email",)}
FORM_NUMBERS = {"employee": (("salary", MONEY), ("warehouse_id", "long"), ("branch_id", "long"))}

def is_blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def explode_lines(docs: DataFrame, kind: str, doc_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Arrays ``product_id``, ``quantity`` (and ``price`` unless kind is
    "transfer") -> one row per line.

    The arrays are cut to the shortest one (a zip stops there; ``arrays_zip`` alone
    would pad with NULL).  Purchase and transfer lines skip a blank product, read
    a blank quantity/price as 0 and drop quantity <= 0; sale lines need all three
    values non-blank.  Text that is not a number goes to the rejects output
    (``doc_id, line_no, reject_reason``) instead of failing the whole batch.
    """
    has_price = kind != "transfer"
    arrays = ["product_id", "quantity"] + (["price"] if has_price else [])
    n = F.least(*[F.size(F.col(a)) for a in arrays])
    zipped = F.arrays_zip(*[F.slice(F.col(a), 1, n).alias(a) for a in arrays])
    raw = (docs.select(doc_col, F.posexplode(zipped).alias("pos", "z"))
           .select(doc_col, (F.col("pos") + 1).alias("line_no"),
                   *[F.col("z")[a].alias(f"raw_{a}") for a in arrays]))

    if kind == "sale":
        keep = ~is_blank(F.col("raw_product_id")) & ~is_blank(F.col("raw_quantity")) & ~is_blank(F.col("raw_price"))
        qty = F.trim(F.col("raw_quantity")).try_cast(MONEY)
        price = F.trim(F.col("raw_price")).try_cast(MONEY)
    else:
        keep = ~is_blank(F.col("raw_product_id"))
        qty = F.when(is_blank(F.col("raw_quantity")), F.lit(0).cast(MONEY)).otherwise(
            F.trim(F.col("raw_quantity")).try_cast(MONEY))
        price = (F.when(is_blank(F.col("raw_price")), F.lit(0).cast(MONEY)).otherwise(
            F.trim(F.col("raw_price")).try_cast(MONEY)) if has_price else None)
    pid = F.trim(F.col("raw_product_id")).try_cast("long")

    cols = [doc_col, "line_no", pid.alias("product_id"), qty.alias("quantity")]
    if has_price:
        cols.append(price.alias("price"))
    typed = raw.where(keep).select(*cols)
    bad = F.col("product_id").isNull() | F.col("quantity").isNull()
    if has_price:
        bad = bad | F.col("price").isNull()
    rejects = typed.where(bad).select(doc_col, "line_no", F.lit("not_a_number").alias("reject_reason"))
    lines = typed.where(~bad)
    if kind != "sale":
        lines = lines.where(F.col("quantity") > 0)
    return lines, rejects


def validate(df: DataFrame, rules: list[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    """``rules`` is a list of (failure condition, reason); the first failing
    rule names the rejection.  Returns (accepted, rejected with ``reject_reason``)."""
    reason = F.lit(None).cast("string")
    for cond, why in reversed(rules):
        reason = F.when(F.coalesce(cond, F.lit(True)), F.lit(why)).otherwise(reason)
    tagged = df.withColumn("reject_reason", reason)
    return (tagged.where(F.col("reject_reason").isNull()).drop("reject_reason"),
            tagged.where(F.col("reject_reason").isNotNull()))


def clean_person(raw: DataFrame, name: str = "name", phone: str = "phone", year: str = "dob_year",
                 month: str = "dob_month", day: str = "dob_day", optional_blank_to_null: tuple[str, ...] = ("email",)
                 ) -> DataFrame:
    """Trim name and phone, blank optional fields -> NULL, y/m/d parts -> date.

    The birth date is set only when all three parts are present; an impossible
    date (e.g. 30 February) gives NULL and ``dob_invalid`` = true instead of an error.
    """
    parts = [F.col(year), F.col(month), F.col(day)]
    all_parts = ~(is_blank(parts[0]) | is_blank(parts[1]) | is_blank(parts[2]))
    y, m, d = (F.trim(p).try_cast("int") for p in parts)
    text = F.format_string("%04d-%02d-%02d", y, m, d)
    dob = F.when(all_parts, F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))))
    out = raw.withColumn(name, F.trim(F.col(name))).withColumn(phone, F.trim(F.col(phone)))
    for c in optional_blank_to_null:
        if c in raw.columns:
            out = out.withColumn(c, F.when(is_blank(F.col(c)), F.lit(None)).otherwise(F.trim(F.col(c))))
    return (out.withColumn("date_of_birth", dob)
            .withColumn("dob_invalid", all_parts & dob.isNull())
            .drop(year, month, day))


def clean_record(raw: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """S5 for a dimension form of ``table``: (cleaned, rejected with ``reject_reason``).

    Required texts are trimmed, optional ones and numbers turn NULL when blank, and
    birth-date parts become a date.  A number that is not one is rejected.
    """
    out = raw
    for c in FORM_TEXT.get(table, ()):
        out = out.withColumn(c, F.trim(F.col(c)))
    for c in FORM_OPTIONAL.get(table, ()):
        out = out.withColumn(c, F.when(~is_blank(F.col(c)), F.trim(F.col(c))))
    rules = []
    for c, kind in FORM_NUMBERS.get(table, ()):
        number = F.trim(F.col(c)).try_cast(kind)
        out = out.withColumn(f"_bad_{c}", ~is_blank(F.col(c)) & number.isNull()).withColumn(c, number)
        rules.append((F.col(f"_bad_{c}"), f"{c}_not_a_number"))
    if "dob_year" in raw.columns:
        out = clean_person(out, FORM_TEXT[table][0], FORM_TEXT[table][1], optional_blank_to_null=())
    good, bad = validate(out, rules)
    extra = [f"_bad_{c}" for c, _ in FORM_NUMBERS.get(table, ())]
    return good.drop(*extra), bad.drop(*extra)
