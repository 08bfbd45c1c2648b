"""Document lifecycle as batch jobs.

Every job takes the current ``Tables`` and a batch (DataFrames of documents or
ids) and returns a ``JobResult``: the new tables (only the changed ones are new
plans) and one decision row per document of the batch.  Nothing is written here;
the caller publishes the changed tables as a new snapshot (sources.tables).

Stock movements of a job are collected first and applied once per location
kind, so a job that touches two places (edits, transfers) is still one shuffle
per stock table.  Feasibility checks use ``admission.admit`` (W3).
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotline.functions.flags import active
from depotline.functions.joins import lookup
from depotline.operators.admission import admit
from depotline.operators.ingest import REQUIRED_TEXT, is_blank, validate
from depotline.operators.stock import apply_update_only, apply_upsert
from depotline.schemas import FOREIGN_KEYS, LINE_KEYS, MONEY
from depotline.session import stage
from depotline.sources.tables import Tables, conform


@dataclasses.dataclass
class JobResult:
    tables: Tables
    decisions: DataFrame  # doc_id, accepted, reason
    stray_lines: DataFrame | None = None  # doc_id, product_id, quantity of lines whose document is not in the batch
    added: dict[str, DataFrame] = dataclasses.field(default_factory=dict)  # of posted sales: table -> its new rows alone


def _decisions(accepted_ids: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    out = accepted_ids.select(F.col("doc_id"), F.lit(True).alias("accepted"),
                              F.lit(None).cast("string").alias("reason"))
    if rejected is not None:
        out = out.unionByName(rejected.select("doc_id", F.lit(False).alias("accepted"),
                                              F.col("reason").cast("string")))
    return out


def _from_admission(adm: DataFrame) -> DataFrame:
    return adm.select("doc_id", "accepted", "reason")


def _ids(ids: DataFrame, key: str) -> DataFrame:
    """Distinct ids of a batch under the column name ``key``."""
    col = key if key in ids.columns else ids.columns[0]
    return ids.select(F.col(col).alias(key)).distinct()


def screen(headers: DataFrame, key: str, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Headers whose id can be used, and rejected ids (doc_id, reason), one row an id.

    An id that is NULL, that the batch holds more than once, or (for new documents)
    that ``existing`` already has is rejected before anything is joined, so a
    repeated header cannot multiply lines, and a batch that is posted again after
    it was published changes nothing.  Headers and ``existing`` ids meet in one shuffle
    and one sort: nearly all ids differ, so hash tables of them would only take memory.
    """
    rows = headers.where(F.col(key).isNotNull()).withColumn("_new", F.lit(1))
    if existing is not None:
        known = existing.select(key).where(F.col(key).isNotNull()).withColumn("_new", F.lit(0))
        rows = rows.unionByName(known, allowMissingColumns=True)
    of_id = Window.partitionBy(key)
    reason = (F.when(F.sum("_new").over(of_id) > 1, F.lit("duplicate_in_batch"))
              .when(F.min("_new").over(of_id) == 0, F.lit("id_exists")))
    seen = rows.withColumn("_reason", reason).where("_new = 1")
    good = seen.where(F.col("_reason").isNull()).select(headers.columns)
    missing = headers.where(F.col(key).isNull()).select(F.col(key).alias("doc_id"), F.lit("missing_id").alias("reason"))
    unusable = seen.where(F.col("_reason").isNotNull()).select(F.col(key).alias("doc_id"), F.col("_reason").alias("reason"))
    return good, unusable.distinct().unionByName(missing.distinct())


def with_unknown(t: Tables, rows: DataFrame, table: str) -> DataFrame:
    """``rows`` of ``table`` with ``_unknown``: the first reference that names no row, as a reason
    (``unknown_<parent>``), else NULL.  A NULL reference is allowed; a deleted parent is a row."""
    columns, reason = rows.columns, F.lit(None).cast("string")
    links = [(c, parent, key) for child, c, parent, key in FOREIGN_KEYS if child == table and c in columns]
    for c, parent, key in links:
        keys = getattr(t, parent).select(F.col(key).alias(c)).dropna().distinct().withColumn(f"_known_{c}", F.lit(True))
        rows = lookup(rows, keys, c)
    for c, parent, _ in reversed(links):
        reason = F.when(F.col(c).isNotNull() & F.col(f"_known_{c}").isNull(), F.lit(f"unknown_{parent}")).otherwise(reason)
    return rows.select(*columns, reason.alias("_unknown"))


def _line_facts(t: Tables, headers: DataFrame, lines: DataFrame, key: str, table: str, counted: bool = True) -> DataFrame:
    """Headers with ``_unknown`` (also ``unknown_product`` of a line) and, if ``counted``, ``n_lines``.  Where
    lines need not be counted, only those without a product are summed up by document."""
    products = t.product.select("product_id").dropna().distinct().withColumn("_product", F.lit(True))
    found = lookup(lines.select(key, "product_id"), products, "product_id")
    if not counted:
        found = found.where(F.col("_product").isNull())
    facts = found.groupBy(key).agg(*[F.count(F.lit(1)).alias("n_lines")] * counted, F.count_if(F.col("_product").isNull()).alias("_strange"))
    # Facts first: screened headers already lie and are sorted by their id.
    out = with_unknown(t, headers.join(facts, key, "left"), table)
    out = out.withColumn("_unknown", F.coalesce("_unknown", F.when(F.col("_strange") > 0, F.lit("unknown_product")))).drop("_strange")
    return out.withColumn("n_lines", F.coalesce("n_lines", F.lit(0))) if counted else out


def _unknown_rules() -> list[tuple[Column, str]]:
    """Rules of ``validate`` for the reasons that ``with_unknown`` gives."""
    return [(F.coalesce(F.col("_unknown"), F.lit("")) == f"unknown_{parent}", f"unknown_{parent}")
            for parent in dict.fromkeys([p for _, _, p, _ in FOREIGN_KEYS])]


def _stray(headers: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """Lines that no document of the batch owns: reported, never dropped in silence."""
    return lines.join(headers.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").select(
        F.col(key).alias("doc_id"), "product_id", "quantity")


def _line_rows(old: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """New lines as rows of their table.  Where lines have keys, new ones still lack theirs:
    ``operators.lines`` gives them when the job is stored."""
    key = LINE_KEYS[name]
    new = conform(new.drop(key), name)
    return new.withColumn(key, F.lit(None).cast("long")) if key in old.columns else new


def _more_lines(old: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """Old lines and new ones."""
    return old.unionByName(_line_rows(old, new, name))


def _rejected(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.lit(False).alias("accepted"), F.col("reason").cast("string").alias("reason"))


def flag_rows(df: DataFrame, ids: DataFrame, key: str, flag: str, value: int | None,
              only: Column | None = None) -> DataFrame:
    """Set ``flag`` to ``value`` (1 or NULL) on rows whose ``key`` is in ``ids``
    (and ``only`` holds).  A left join on distinct ids never adds rows."""
    hit = _ids(ids, key).withColumn("_hit", F.lit(True))
    cond = F.col("_hit").isNotNull()
    if only is not None:
        cond = cond & F.coalesce(only, F.lit(False))
    new = F.lit(value).cast("int") if value is not None else F.lit(None).cast("int")
    return (df.join(hit, key, "left").withColumn(flag, F.when(cond, new).otherwise(F.col(flag)))
            .drop("_hit").select(*df.columns))


def _wh_deltas(lines: DataFrame, sign: int) -> DataFrame:
    return lines.select("warehouse_id", "product_id", (F.col("quantity") * F.lit(sign)).alias("delta"))


def _br_deltas(lines: DataFrame, sign: int) -> DataFrame:
    return lines.select("branch_id", "product_id", (F.col("quantity") * F.lit(sign)).alias("delta"))


def _demand(lines: DataFrame, date_col: str, doc_col: str, kind: str, loc_col: str,
            qty: Column | None = None) -> DataFrame:
    return lines.select(F.col(doc_col).alias("doc_id"), F.col(date_col).alias("doc_date"),
                        F.lit(kind).alias("location_type"), F.col(loc_col).alias("location_id"),
                        "product_id", (qty if qty is not None else F.col("quantity")).alias("qty"))


def _stock(df: DataFrame, kind: str, loc_col: str) -> DataFrame:
    return df.select(F.lit(kind).alias("location_type"), F.col(loc_col).alias("location_id"),
                     "product_id", "quantity")


# ------------------------------------------------------------------- purchases

def post_purchases(t: Tables, headers: DataFrame, lines: DataFrame) -> JobResult:
    """Append purchases and add their lines to warehouse stock (insert-or-add).

    ``headers``: purchase_id, employee_id, warehouse_id, supplier_id, purchase_date.
    ``lines``: purchase_id, product_id, quantity, price (already exploded by S4).
    A purchase needs a supplier, a warehouse and at least one line (S6), and every
    reference of it and its lines must name a row.
    """
    stray = _stray(headers, lines, "purchase_id")
    headers, unusable = screen(headers, "purchase_id", t.purchase)
    h = stage(_line_facts(t, headers, lines, "purchase_id", "purchase"), "purchase-batch")
    ok, bad = validate(h, [(F.col("supplier_id").isNull(), "missing_supplier"),
                           (F.col("warehouse_id").isNull(), "missing_warehouse"),
                           (F.col("n_lines") == 0, "no_lines"), *_unknown_rules()])
    ok = ok.drop("n_lines", "_unknown")
    new_lines = (lines.join(ok.select("purchase_id", "warehouse_id"), "purchase_id")
                 .withColumn("kg_price_at_purchase_time", F.col("price").cast(MONEY)))
    purchase = t.purchase.unionByName(conform(ok.withColumn("is_deleted", F.lit(None)), "purchase"))
    detail = _more_lines(t.purchase_detail, new_lines.withColumn("is_deleted", F.lit(None)).withColumn("is_deleted_with_purchase", F.lit(None)),
                         "purchase_detail")
    stock = apply_upsert(t.warehouse_stock, _wh_deltas(new_lines, 1), "warehouse_id")
    return JobResult(t.replace(purchase=purchase, purchase_detail=detail, warehouse_stock=conform(stock, "warehouse_stock")),
                     _decisions(ok.select(F.col("purchase_id").alias("doc_id")),
                                bad.select(F.col("purchase_id").alias("doc_id"), F.col("reject_reason").alias("reason"))
                                .unionByName(unusable)), stray)


def _purchase_live_lines(t: Tables, purchases: DataFrame) -> DataFrame:
    return (purchases.select("purchase_id", "warehouse_id", "purchase_date")
            .join(active(t.purchase_detail).select("purchase_id", "product_id", "quantity"), "purchase_id"))


def delete_purchases(t: Tables, purchase_ids: DataFrame) -> JobResult:
    """An active purchase is deleted only if its warehouse still holds its live
    line quantities; then -warehouse, cascade flag on *all* its lines and payments,
    header flag.  Purchases that are not active are rejected as not found."""
    ids = _ids(purchase_ids, "purchase_id")
    heads = stage(active(t.purchase).join(ids, "purchase_id", "left_semi"), "purchase-heads")
    not_found = ids.join(heads, "purchase_id", "left_anti").select(
        F.col("purchase_id").alias("doc_id"), F.lit("not_found").alias("reason"))
    lines = stage(_purchase_live_lines(t, heads), "purchase-lines")
    adm = admit(_demand(lines, "purchase_date", "purchase_id", "warehouse", "warehouse_id"),
                _stock(t.warehouse_stock, "warehouse", "warehouse_id"),
                docs=heads.select(F.col("purchase_id").alias("doc_id")))
    acc = adm.where("accepted").select(F.col("doc_id").alias("purchase_id"))
    stock = apply_upsert(t.warehouse_stock, _wh_deltas(lines.join(acc, "purchase_id", "left_semi"), -1),
                         "warehouse_id")
    return JobResult(
        t.replace(purchase=flag_rows(t.purchase, acc, "purchase_id", "is_deleted", 1),
                  purchase_detail=flag_rows(t.purchase_detail, acc, "purchase_id", "is_deleted_with_purchase", 1),
                  payment=flag_rows(t.payment, acc, "purchase_id", "is_deleted_with_purchase", 1),
                  warehouse_stock=conform(stock, "warehouse_stock")),
        _from_admission(adm).unionByName(not_found.select("doc_id", F.lit(False).alias("accepted"), "reason")))


def recover_purchases(t: Tables, purchase_ids: DataFrame) -> JobResult:
    """A deleted purchase with at least one line that carries the cascade flag
    and is not itself deleted comes back: +warehouse for those lines, flags cleared
    (lines: only the not-deleted ones; payments: all).  No stock check (D6)."""
    ids = _ids(purchase_ids, "purchase_id")
    heads = t.purchase.join(ids, "purchase_id", "left_semi")
    back_lines = (t.purchase_detail.where((F.col("is_deleted_with_purchase") == 1) & F.col("is_deleted").isNull())
                  .join(heads.where(F.col("is_deleted").isNotNull()).select("purchase_id", "warehouse_id"),
                        "purchase_id"))
    acc = back_lines.select("purchase_id").distinct()
    known = t.purchase.select("purchase_id", "is_deleted", F.lit(1).alias("_known"))
    rejected = (ids.join(acc, "purchase_id", "left_anti").join(known, "purchase_id", "left")
                .select(F.col("purchase_id").alias("doc_id"),
                        F.when(F.col("_known").isNull(), F.lit("not_found"))
                        .when(F.col("is_deleted").isNull(), F.lit("already_active"))
                        .otherwise(F.lit("no_lines_to_recover")).alias("reason")))
    stock = apply_upsert(t.warehouse_stock, _wh_deltas(back_lines, 1), "warehouse_id")
    detail = flag_rows(t.purchase_detail, acc, "purchase_id", "is_deleted_with_purchase", None,
                       only=F.col("is_deleted").isNull())
    return JobResult(
        t.replace(purchase=flag_rows(t.purchase, acc, "purchase_id", "is_deleted", None),
                  purchase_detail=detail,
                  payment=flag_rows(t.payment, acc, "purchase_id", "is_deleted_with_purchase", None),
                  warehouse_stock=conform(stock, "warehouse_stock")),
        _decisions(acc.select(F.col("purchase_id").alias("doc_id")), rejected))


def edit_purchases(t: Tables, headers: DataFrame, lines: DataFrame) -> JobResult:
    """Replace supplier, warehouse, date and lines of active purchases.

    The old live quantities must still be in the old warehouse (checked as W3
    demand); accepted edits take them out, flag every old line deleted, append the
    new lines and add them to the new warehouse - one summed delta per stock key.
    ``headers``: purchase_id, supplier_id, warehouse_id, purchase_date (new values).
    """
    stray = _stray(headers, lines, "purchase_id")
    cur = active(t.purchase).select("purchase_id", F.col("warehouse_id").alias("old_wh"),
                                    F.col("purchase_date").alias("old_date"))
    headers, unusable = screen(headers, "purchase_id")
    h = stage(_line_facts(t, headers, lines, "purchase_id", "purchase").join(cur, "purchase_id", "left"), "purchase-edits")
    ok, bad = validate(h, [(F.col("old_wh").isNull(), "not_found"),
                           (F.col("supplier_id").isNull() | F.col("warehouse_id").isNull(), "missing_supplier_or_warehouse"),
                           (F.col("n_lines") == 0, "no_lines"), *_unknown_rules()])
    old_lines = stage(ok.select("purchase_id", F.col("old_wh").alias("warehouse_id"),
                                F.col("old_date").alias("purchase_date"))
                      .join(active(t.purchase_detail).select("purchase_id", "product_id", "quantity"), "purchase_id"),
                      "purchase-old-lines")
    adm = admit(_demand(old_lines, "purchase_date", "purchase_id", "warehouse", "warehouse_id"),
                _stock(t.warehouse_stock, "warehouse", "warehouse_id"),
                docs=ok.select(F.col("purchase_id").alias("doc_id")))
    acc = adm.where("accepted").select(F.col("doc_id").alias("purchase_id"))
    new_heads = ok.join(acc, "purchase_id", "left_semi")
    new_lines = (lines.join(new_heads.select("purchase_id", "warehouse_id"), "purchase_id")
                 .withColumn("kg_price_at_purchase_time", F.col("price").cast(MONEY)))
    deltas = (_wh_deltas(old_lines.join(acc, "purchase_id", "left_semi"), -1)
              .unionByName(_wh_deltas(new_lines, 1)))
    upd = new_heads.select("purchase_id", F.col("supplier_id").alias("n_sup"), F.col("warehouse_id").alias("n_wh"),
                           F.col("purchase_date").alias("n_date"))
    purchase = (t.purchase.join(upd, "purchase_id", "left").select(
        "purchase_id", "employee_id",
        F.coalesce("n_wh", "warehouse_id").alias("warehouse_id"),
        F.coalesce("n_sup", "supplier_id").alias("supplier_id"),
        F.when(F.col("n_wh").isNotNull(), F.col("n_date")).otherwise(F.col("purchase_date")).alias("purchase_date"),
        "is_deleted"))
    detail = _more_lines(flag_rows(t.purchase_detail, acc, "purchase_id", "is_deleted", 1),
                         new_lines.withColumn("is_deleted", F.lit(None)).withColumn("is_deleted_with_purchase", F.lit(None)), "purchase_detail")
    stock = apply_upsert(t.warehouse_stock, deltas, "warehouse_id")
    return JobResult(
        t.replace(purchase=conform(purchase, "purchase"), purchase_detail=detail,
                  warehouse_stock=conform(stock, "warehouse_stock")),
        _from_admission(adm).unionByName(
            bad.select(F.col("purchase_id").alias("doc_id"), F.lit(False).alias("accepted"),
                       F.col("reject_reason").alias("reason"))).unionByName(_rejected(unusable)), stray)


# -------------------------------------------------------------------- payments

def post_payments(t: Tables, payments: DataFrame) -> JobResult:
    """Append payments (payment_id, purchase_id, employee_id, payment_date, amount, method)."""
    payments, unusable = screen(payments, "payment_id", t.payment)
    ok, bad = validate(with_unknown(t, payments, "payment"), [(F.col("purchase_id").isNull(), "missing_purchase"),
                                                              (F.col("amount").isNull(), "missing_amount"), *_unknown_rules()])
    new = conform(ok.withColumn("is_deleted", F.lit(None)).withColumn("is_deleted_with_purchase", F.lit(None)),
                  "payment")
    return JobResult(t.replace(payment=t.payment.unionByName(new)),
                     _decisions(ok.select(F.col("payment_id").alias("doc_id")),
                                bad.select(F.col("payment_id").alias("doc_id"), F.col("reject_reason").alias("reason"))
                                .unionByName(unusable)))


def delete_payments(t: Tables, payment_ids: DataFrame) -> JobResult:
    """Soft-delete payments by id."""
    ids = _ids(payment_ids, "payment_id")
    found = ids.join(t.payment, "payment_id", "left_semi")
    return JobResult(t.replace(payment=flag_rows(t.payment, found, "payment_id", "is_deleted", 1)),
                     _decisions(found.select(F.col("payment_id").alias("doc_id")),
                                ids.join(found, "payment_id", "left_anti").select(
                                    F.col("payment_id").alias("doc_id"), F.lit("not_found").alias("reason"))))


# ----------------------------------------------------------------------- sales

def post_sales(t: Tables, headers: DataFrame, lines: DataFrame, check_stock: bool = False) -> JobResult:
    """Append sales and take their lines out of branch stock (update-only: a
    pair without a stock row keeps no stock change, the sale is kept - D5).

    ``check_stock=True`` admits sales against branch stock first (W3).
    ``headers``: sale_id, customer_id, branch_id, employee_id, sale_date, payment_method.
    ``lines``: sale_id, product_id, quantity, price.
    """
    stray = _stray(headers, lines, "sale_id")
    headers, unusable = screen(headers, "sale_id", t.sale)
    h = stage(_line_facts(t, headers, lines, "sale_id", "sale", counted=False), "sale-batch")
    heads, bad = validate(h, [(F.col("branch_id").isNull(), "missing_branch"), *_unknown_rules()])
    heads = heads.drop("_unknown")
    sale_lines = lines.join(heads.select("sale_id", "branch_id", "sale_date"), "sale_id")
    if check_stock:
        adm = admit(_demand(sale_lines, "sale_date", "sale_id", "branch", "branch_id"),
                    _stock(t.branch_stock, "branch", "branch_id"), docs=heads.select(F.col("sale_id").alias("doc_id")))
        acc = adm.where("accepted").select(F.col("doc_id").alias("sale_id"))
        heads = heads.join(acc, "sale_id", "left_semi")
        sale_lines = sale_lines.join(acc, "sale_id", "left_semi")
        decisions = _from_admission(adm)
    else:
        decisions = _decisions(heads.select(F.col("sale_id").alias("doc_id")))
    bad = bad.select(F.col("sale_id").alias("doc_id"), F.col("reject_reason").alias("reason"))
    decisions = decisions.unionByName(_rejected(bad)).unionByName(_rejected(unusable))
    new_stock, _ = apply_update_only(t.branch_stock, _br_deltas(sale_lines, -1), "branch_id")
    added = {"sale": conform(heads.withColumn("is_deleted", F.lit(None)), "sale"),
             "sale_detail": _line_rows(t.sale_detail, sale_lines.withColumn("kg_price_at_sale_time", F.col("price").cast(MONEY))
                                       .withColumn("is_deleted", F.lit(None)).withColumn("is_deleted_with_sale", F.lit(None)), "sale_detail")}
    more = {name: getattr(t, name).unionByName(rows) for name, rows in added.items()}
    return JobResult(t.replace(**more, branch_stock=conform(new_stock, "branch_stock")), decisions, stray, added)


def delete_sales(t: Tables, sale_ids: DataFrame) -> JobResult:
    """Only active sales (D3); their live lines go back to the sale's own
    branch (D2, update-only); header flag; cascade flag on live lines only."""
    ids = _ids(sale_ids, "sale_id")
    heads = active(t.sale).join(ids, "sale_id", "left_semi")
    acc = heads.select("sale_id")
    lines = heads.select("sale_id", "branch_id").join(
        active(t.sale_detail).select("sale_id", "product_id", "quantity"), "sale_id")
    new_stock, _ = apply_update_only(t.branch_stock, _br_deltas(lines, 1), "branch_id")
    return JobResult(
        t.replace(sale=flag_rows(t.sale, acc, "sale_id", "is_deleted", 1),
                  sale_detail=flag_rows(t.sale_detail, acc, "sale_id", "is_deleted_with_sale", 1,
                                        only=F.col("is_deleted").isNull()),
                  branch_stock=conform(new_stock, "branch_stock")),
        _decisions(acc.select(F.col("sale_id").alias("doc_id")),
                   ids.join(acc, "sale_id", "left_anti").select(F.col("sale_id").alias("doc_id"),
                                                                F.lit("not_active").alias("reason"))))


def recover_sales(t: Tables, sale_ids: DataFrame) -> JobResult:
    """A deleted sale comes back if its branch holds the quantities of its
    cascade-flagged lines (a missing stock row rejects); then -branch, flags cleared."""
    ids = _ids(sale_ids, "sale_id")
    heads = stage(t.sale.where(F.col("is_deleted").isNotNull()).join(ids, "sale_id", "left_semi"), "sale-heads")
    lines = stage(heads.select("sale_id", "branch_id", "sale_date").join(
        t.sale_detail.where(F.col("is_deleted_with_sale") == 1).select("sale_id", "product_id", "quantity"),
        "sale_id"), "sale-lines")
    adm = admit(_demand(lines, "sale_date", "sale_id", "branch", "branch_id"),
                _stock(t.branch_stock, "branch", "branch_id"), docs=heads.select(F.col("sale_id").alias("doc_id")),
                missing_rejects=True)
    acc = adm.where("accepted").select(F.col("doc_id").alias("sale_id"))
    new_stock, _ = apply_update_only(t.branch_stock, _br_deltas(lines.join(acc, "sale_id", "left_semi"), -1),
                                     "branch_id")
    not_deleted = ids.join(heads, "sale_id", "left_anti").select(
        F.col("sale_id").alias("doc_id"), F.lit(False).alias("accepted"), F.lit("not_deleted").alias("reason"))
    return JobResult(
        t.replace(sale=flag_rows(t.sale, acc, "sale_id", "is_deleted", None),
                  sale_detail=flag_rows(t.sale_detail, acc, "sale_id", "is_deleted_with_sale", None,
                                        only=F.col("is_deleted_with_sale") == 1),
                  branch_stock=conform(new_stock, "branch_stock")),
        _from_admission(adm).unionByName(not_deleted))


def edit_sales(t: Tables, headers: DataFrame, lines: DataFrame) -> JobResult:
    """Give back the old live lines, re-flag all old lines, update customer,
    date and payment method, append the new lines and take them out - one summed
    delta per (branch, product), applied update-only at the sale's own branch."""
    cur = active(t.sale).select("sale_id", "branch_id")
    stray = _stray(headers, lines, "sale_id")
    headers, unusable = screen(headers, "sale_id")
    h = stage(_line_facts(t, headers.drop("branch_id"), lines, "sale_id", "sale", counted=False).join(cur, "sale_id", "left"), "sale-edits")
    heads, bad = validate(h, [(F.col("branch_id").isNull(), "not_active"), *_unknown_rules()])
    acc = heads.select("sale_id")
    old = cur.join(acc, "sale_id", "left_semi").join(
        active(t.sale_detail).select("sale_id", "product_id", "quantity"), "sale_id")
    new_lines = lines.join(heads.select("sale_id", "branch_id"), "sale_id")
    deltas = _br_deltas(old, 1).unionByName(_br_deltas(new_lines, -1))
    new_stock, _ = apply_update_only(t.branch_stock, deltas, "branch_id")
    upd = heads.select("sale_id", F.lit(True).alias("_e"), F.col("customer_id").alias("n_cust"),
                       F.col("sale_date").alias("n_date"), F.col("payment_method").alias("n_pm"))
    e = F.col("_e").isNotNull()
    sale = t.sale.join(upd, "sale_id", "left").select(
        "sale_id", F.when(e, F.col("n_cust")).otherwise(F.col("customer_id")).alias("customer_id"),
        "branch_id", "employee_id",
        F.when(e, F.col("n_date")).otherwise(F.col("sale_date")).alias("sale_date"),
        F.when(e, F.col("n_pm")).otherwise(F.col("payment_method")).alias("payment_method"), "is_deleted")
    detail = _more_lines(flag_rows(t.sale_detail, acc, "sale_id", "is_deleted", 1),
                         new_lines.withColumn("kg_price_at_sale_time", F.col("price").cast(MONEY))
                         .withColumn("is_deleted", F.lit(None)).withColumn("is_deleted_with_sale", F.lit(None)), "sale_detail")
    return JobResult(
        t.replace(sale=conform(sale, "sale"), sale_detail=detail, branch_stock=conform(new_stock, "branch_stock")),
        _decisions(acc.select(F.col("sale_id").alias("doc_id")),
                   bad.select(F.col("sale_id").alias("doc_id"), F.col("reject_reason").alias("reason")).unionByName(unusable)), stray)


# ------------------------------------------------------------------- transfers

def post_transfers(t: Tables, headers: DataFrame, lines: DataFrame) -> JobResult:
    """A transfer needs a branch and at least one line; the warehouse must
    cover all of its lines (W3); then -warehouse, +branch (insert-or-add both).

    ``headers``: transfer_id, warehouse_id, branch_id, employee_id, transfer_date.
    ``lines``: transfer_id, product_id, quantity.
    """
    stray = _stray(headers, lines, "transfer_id")
    headers, unusable = screen(headers, "transfer_id", t.transfer)
    h = stage(_line_facts(t, headers, lines, "transfer_id", "transfer"), "transfer-batch")
    ok, bad = validate(h, [(F.col("branch_id").isNull(), "missing_branch"),
                           (F.col("warehouse_id").isNull(), "missing_warehouse"),
                           (F.col("n_lines") == 0, "no_lines"), *_unknown_rules()])
    ok = ok.drop("n_lines", "_unknown")
    tl = stage(lines.join(ok.select("transfer_id", "warehouse_id", "branch_id", "transfer_date"), "transfer_id"),
               "transfer-lines")
    adm = admit(_demand(tl, "transfer_date", "transfer_id", "warehouse", "warehouse_id"),
                _stock(t.warehouse_stock, "warehouse", "warehouse_id"),
                docs=ok.select(F.col("transfer_id").alias("doc_id")))
    acc = adm.where("accepted").select(F.col("doc_id").alias("transfer_id"))
    moved = tl.join(acc, "transfer_id", "left_semi")
    return JobResult(
        t.replace(transfer=t.transfer.unionByName(conform(ok.join(acc, "transfer_id", "left_semi"), "transfer")),
                  transfer_detail=_more_lines(t.transfer_detail, moved, "transfer_detail"),
                  warehouse_stock=conform(apply_upsert(t.warehouse_stock, _wh_deltas(moved, -1), "warehouse_id"),
                                          "warehouse_stock"),
                  branch_stock=conform(apply_upsert(t.branch_stock, _br_deltas(moved, 1), "branch_id"),
                                       "branch_stock")),
        _from_admission(adm).unionByName(
            bad.select(F.col("transfer_id").alias("doc_id"), F.lit(False).alias("accepted"),
                       F.col("reject_reason").alias("reason"))).unionByName(_rejected(unusable)), stray)


def delete_transfers(t: Tables, transfer_ids: DataFrame) -> JobResult:
    """The branch must still hold the transferred quantities (W3); then
    +warehouse, -branch and the transfer and its lines are removed."""
    ids = _ids(transfer_ids, "transfer_id")
    heads = stage(t.transfer.join(ids, "transfer_id", "left_semi"), "transfer-heads")
    tl = stage(heads.select("transfer_id", "warehouse_id", "branch_id", "transfer_date").join(
        t.transfer_detail.select("transfer_id", "product_id", "quantity"), "transfer_id"), "transfer-lines")
    adm = admit(_demand(tl, "transfer_date", "transfer_id", "branch", "branch_id"),
                _stock(t.branch_stock, "branch", "branch_id"), docs=heads.select(F.col("transfer_id").alias("doc_id")))
    acc = adm.where("accepted").select(F.col("doc_id").alias("transfer_id"))
    moved = tl.join(acc, "transfer_id", "left_semi")
    not_found = ids.join(heads, "transfer_id", "left_anti").select(
        F.col("transfer_id").alias("doc_id"), F.lit(False).alias("accepted"), F.lit("not_found").alias("reason"))
    return JobResult(
        t.replace(transfer=t.transfer.join(acc, "transfer_id", "left_anti"),
                  transfer_detail=t.transfer_detail.join(acc, "transfer_id", "left_anti"),
                  warehouse_stock=conform(apply_upsert(t.warehouse_stock, _wh_deltas(moved, 1), "warehouse_id"),
                                          "warehouse_stock"),
                  branch_stock=conform(apply_upsert(t.branch_stock, _br_deltas(moved, -1), "branch_id"),
                                       "branch_stock")),
        _from_admission(adm).unionByName(not_found))


def edit_transfers(t: Tables, headers: DataFrame, lines: DataFrame) -> JobResult:
    """New warehouse, branch, date and lines for existing transfers.

    Checks, in one admission over both location kinds: the old branch must hold
    the old quantities; the new warehouse must cover the new quantities, counting
    the transfer's own old quantity back when the warehouse is unchanged.  Where
    that add-back makes the need non-positive the line is tested alone
    (stock + old >= new) and adds no demand.  Accepted edits reverse the old
    movement, replace the lines and apply the new movement.
    """
    stray = _stray(headers, lines, "transfer_id")
    cur = t.transfer.select("transfer_id", F.col("warehouse_id").alias("old_wh"), F.col("branch_id").alias("old_br"),
                            F.col("transfer_date").alias("old_date"))
    headers, unusable = screen(headers, "transfer_id")
    h = stage(_line_facts(t, headers, lines, "transfer_id", "transfer").join(cur, "transfer_id", "left"), "transfer-edits")
    ok, bad = validate(h, [(F.col("old_wh").isNull(), "not_found"),
                           (F.col("warehouse_id").isNull() | F.col("branch_id").isNull(), "missing_warehouse_or_branch"),
                           (F.col("n_lines") == 0, "no_lines"), *_unknown_rules()])
    old = stage(ok.select("transfer_id", "old_wh", "old_br", "old_date").join(
        t.transfer_detail.select("transfer_id", "product_id", "quantity"), "transfer_id"), "transfer-old-lines")
    old_per_product = old.groupBy("transfer_id", "product_id").agg(F.sum("quantity").alias("old_qty"))
    new = (lines.groupBy("transfer_id", "product_id").agg(F.sum("quantity").alias("new_qty"))
           .join(ok.select("transfer_id", "warehouse_id", "old_wh", "old_date"), "transfer_id")
           .join(old_per_product, ["transfer_id", "product_id"], "left")
           .withColumn("add_back", F.when(F.col("warehouse_id") == F.col("old_wh"),
                                          F.coalesce(F.col("old_qty"), F.lit(0))).otherwise(F.lit(0)))
           .withColumn("need", F.col("new_qty") - F.col("add_back")))
    new = stage(new, "transfer-new-lines")
    # Lines whose need is not positive are tested alone against the stock row.
    alone = (new.where(F.col("need") <= 0)
             .join(t.warehouse_stock.select("warehouse_id", "product_id", F.col("quantity").alias("s")),
                   ["warehouse_id", "product_id"], "left")
             .where(F.coalesce(F.col("s"), F.lit(0)) + F.col("add_back") < F.col("new_qty"))
             .select(F.col("transfer_id").alias("doc_id")).distinct())
    alone = stage(alone, "transfer-alone")
    demand = (_demand(old, "old_date", "transfer_id", "branch", "old_br")
              .unionByName(_demand(new.where(F.col("need") > 0), "old_date", "transfer_id", "warehouse",
                                   "warehouse_id", qty=F.col("need"))))
    stock = (_stock(t.branch_stock, "branch", "branch_id")
             .unionByName(_stock(t.warehouse_stock, "warehouse", "warehouse_id")))
    candidates = stage(ok.select(F.col("transfer_id").alias("doc_id")).join(alone, "doc_id", "left_anti"), "transfer-candidates")
    adm = admit(demand.join(candidates, "doc_id", "left_semi"), stock, docs=candidates)
    acc = adm.where("accepted").select(F.col("doc_id").alias("transfer_id"))
    new_heads = ok.join(acc, "transfer_id", "left_semi")
    old_acc = old.join(acc, "transfer_id", "left_semi")
    new_lines = lines.join(new_heads.select("transfer_id", "warehouse_id", "branch_id"), "transfer_id")
    wh_d = (old_acc.select(F.col("old_wh").alias("warehouse_id"), "product_id", F.col("quantity").alias("delta"))
            .unionByName(_wh_deltas(new_lines, -1)))
    br_d = (old_acc.select(F.col("old_br").alias("branch_id"), "product_id", (-F.col("quantity")).alias("delta"))
            .unionByName(_br_deltas(new_lines, 1)))
    upd = new_heads.select("transfer_id", F.col("warehouse_id").alias("n_wh"), F.col("branch_id").alias("n_br"),
                           F.col("transfer_date").alias("n_date"))
    transfer = t.transfer.join(upd, "transfer_id", "left").select(
        "transfer_id", F.coalesce("n_wh", "warehouse_id").alias("warehouse_id"),
        F.coalesce("n_br", "branch_id").alias("branch_id"), "employee_id",
        F.when(F.col("n_wh").isNotNull(), F.col("n_date")).otherwise(F.col("transfer_date")).alias("transfer_date"))
    detail = _more_lines(t.transfer_detail.join(acc, "transfer_id", "left_anti"), new_lines, "transfer_detail")
    rejected = (bad.select(F.col("transfer_id").alias("doc_id"), F.col("reject_reason").alias("reason"))
                .unionByName(alone.select("doc_id", F.lit("insufficient_stock").alias("reason")))
                .unionByName(unusable))
    return JobResult(
        t.replace(transfer=conform(transfer, "transfer"), transfer_detail=detail,
                  warehouse_stock=conform(apply_upsert(t.warehouse_stock, wh_d, "warehouse_id"), "warehouse_stock"),
                  branch_stock=conform(apply_upsert(t.branch_stock, br_d, "branch_id"), "branch_stock")),
        _from_admission(adm).unionByName(rejected.select("doc_id", F.lit(False).alias("accepted"), "reason")), stray)


# ------------------------------------------------------------------ dimensions

_DIM_KEYS = {"supplier": "supplier_id", "product": "product_id", "employee": "employee_id",
             "branch": "branch_id", "customer": "customer_id", "warehouse": "warehouse_id"}


def _found(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Decisions for ids of existing rows: those without a row are not found."""
    here = ids.join(df.select(key).distinct(), key, "left_semi").select(F.col(key).alias("doc_id"))
    gone = ids.join(df.select(key), key, "left_anti").select(F.col(key).alias("doc_id"), F.lit("not_found").alias("reason"))
    return _decisions(here, gone)


def set_deleted(t: Tables, table: str, ids: DataFrame, deleted: bool = True) -> JobResult:
    """Soft-delete (or recover) supplier, product, employee or branch rows by id."""
    key = _DIM_KEYS[table]
    df, ids = getattr(t, table), _ids(ids, key)
    return JobResult(t.replace(**{table: flag_rows(df, ids, key, "is_deleted", 1 if deleted else None)}), _found(df, ids, key))


def upsert_rows(t: Tables, table: str, rows: DataFrame) -> JobResult:
    """Insert new rows and overwrite existing ones by id (type-1).

    Only the columns that ``rows`` brings are written; the others keep their value,
    and the delete flag is never touched (a new row is active).  Rejected: a NULL
    or repeated id, a row without the texts that the table requires (S6; for a new id
    also where ``rows`` has no such column), and a reference to a row that is not there.
    """
    key, old = _DIM_KEYS[table], getattr(t, table)
    rows, unusable = screen(rows, key)
    known = old.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_old", F.lit(True))
    rules = [(is_blank(F.col(c)) if c in rows.columns else F.col("_old").isNull(), f"missing_{c}") for c in REQUIRED_TEXT.get(table, ())]
    ok, bad = validate(with_unknown(t, rows, table).join(known, key, "left"), [*rules, *_unknown_rules()])
    ok, bad = ok.drop("_old", "_unknown"), bad.drop("_old", "_unknown")
    brought = [c for c in old.columns if c in ok.columns and c not in (key, "is_deleted")]
    types = dict(zip(old.columns, (f.dataType for f in old.schema.fields)))
    new = ok.select(key, *(F.col(c).cast(types[c]).alias(f"_new_{c}") for c in brought), F.lit(True).alias("_hit"))
    both = old.withColumn("_old", F.lit(True)).join(new, key, "full_outer")
    merged = both.select(*(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in brought else F.col(c)
                           for c in old.columns))
    return JobResult(t.replace(**{table: conform(merged, table)}),
                     _decisions(ok.select(F.col(key).alias("doc_id")),
                                bad.select(F.col(key).alias("doc_id"), F.col("reject_reason").alias("reason")).unionByName(unusable)))


def delete_customers(t: Tables, customer_ids: DataFrame) -> JobResult:
    """Remove customers; their sales keep going as walk-in sales (customer NULL)."""
    ids = _ids(customer_ids, "customer_id")
    hit = ids.withColumn("_hit", F.lit(True))
    sale = (lookup(t.sale, hit, "customer_id")
            .withColumn("customer_id", F.when(F.col("_hit").isNull(), F.col("customer_id")))
            .drop("_hit"))
    return JobResult(t.replace(customer=t.customer.join(ids, "customer_id", "left_anti"), sale=conform(sale, "sale")),
                     _found(t.customer, ids, "customer_id"))


def delete_warehouses(t: Tables, warehouse_ids: DataFrame) -> JobResult:
    """A warehouse is removed only if no employee, purchase, transfer or stock
    row refers to it."""
    ids = _ids(warehouse_ids, "warehouse_id")
    refs = (t.employee.select("warehouse_id").unionByName(t.purchase.select("warehouse_id"))
            .unionByName(t.transfer.select("warehouse_id")).unionByName(t.warehouse_stock.select("warehouse_id"))
            .where(F.col("warehouse_id").isNotNull()).distinct())
    acc = ids.join(refs, "warehouse_id", "left_anti").join(t.warehouse, "warehouse_id", "left_semi")
    rej = ids.join(acc, "warehouse_id", "left_anti").join(refs.withColumn("_ref", F.lit(1)), "warehouse_id", "left")
    return JobResult(
        t.replace(warehouse=t.warehouse.join(acc, "warehouse_id", "left_anti")),
        _decisions(acc.select(F.col("warehouse_id").alias("doc_id")),
                   rej.select(F.col("warehouse_id").alias("doc_id"),
                              F.when(F.col("_ref").isNotNull(), F.lit("referenced"))
                              .otherwise(F.lit("not_found")).alias("reason"))))
