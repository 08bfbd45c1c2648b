"""Fixed schemas of the fifteen tables (ids long, flags int, money decimal(10,2)).

Flags use NULL for "active" and 1 for "deleted"; any other value is in neither
list.  Stock quantities are wider (decimal(20,2)) because they are running sums.
The employee password and the unused stock cascade flags are not part of the lake.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
STOCK_QTY = T.DecimalType(20, 2)
ID = T.LongType()
FLAG = T.IntegerType()


def _s(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SCHEMAS: dict[str, T.StructType] = {
    "warehouse": _s(("warehouse_id", ID), ("warehouse_name", T.StringType()),
                    ("location", T.StringType()), ("phone_number", T.StringType())),
    "branch": _s(("branch_id", ID), ("branch_name", T.StringType()), ("location", T.StringType()),
                 ("phone_number", T.StringType()), ("is_deleted", FLAG)),
    "employee": _s(("employee_id", ID), ("employee_name", T.StringType()),
                   ("phone_number", T.StringType()), ("date_of_birth", T.DateType()),
                   ("position", T.StringType()), ("salary", MONEY), ("warehouse_id", ID),
                   ("branch_id", ID), ("is_deleted", FLAG), ("access_level", T.StringType())),
    "customer": _s(("customer_id", ID), ("customer_name", T.StringType()),
                   ("phone_number", T.StringType()), ("date_of_birth", T.DateType()),
                   ("email", T.StringType())),
    "supplier": _s(("supplier_id", ID), ("supplier_name", T.StringType()), ("location", T.StringType()),
                   ("phone_number", T.StringType()), ("email", T.StringType()), ("is_deleted", FLAG)),
    "product": _s(("product_id", ID), ("product_name", T.StringType()), ("category", T.StringType()),
                  ("is_deleted", FLAG), ("purchase_price_per_kg", MONEY), ("sale_price_per_kg", MONEY)),
    "purchase": _s(("purchase_id", ID), ("employee_id", ID), ("warehouse_id", ID), ("supplier_id", ID),
                   ("purchase_date", T.DateType()), ("is_deleted", FLAG)),
    "purchase_detail": _s(("purchase_id", ID), ("product_id", ID), ("quantity", MONEY),
                          ("kg_price_at_purchase_time", MONEY), ("is_deleted", FLAG),
                          ("is_deleted_with_purchase", FLAG)),
    "payment": _s(("payment_id", ID), ("purchase_id", ID), ("employee_id", ID), ("payment_date", T.DateType()),
                  ("amount", MONEY), ("method", T.StringType()), ("is_deleted", FLAG),
                  ("is_deleted_with_purchase", FLAG)),
    "sale": _s(("sale_id", ID), ("customer_id", ID), ("branch_id", ID), ("employee_id", ID),
               ("sale_date", T.DateType()), ("payment_method", T.StringType()), ("is_deleted", FLAG)),
    "sale_detail": _s(("sale_id", ID), ("product_id", ID), ("quantity", MONEY),
                      ("kg_price_at_sale_time", MONEY), ("is_deleted", FLAG), ("is_deleted_with_sale", FLAG)),
    "transfer": _s(("transfer_id", ID), ("warehouse_id", ID), ("branch_id", ID), ("employee_id", ID),
                   ("transfer_date", T.DateType())),
    "transfer_detail": _s(("transfer_id", ID), ("product_id", ID), ("quantity", MONEY)),
    "warehouse_stock": _s(("warehouse_id", ID), ("product_id", ID), ("quantity", STOCK_QTY)),
    "branch_stock": _s(("branch_id", ID), ("product_id", ID), ("quantity", STOCK_QTY)),
}

TABLE_NAMES = tuple(SCHEMAS)

PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "warehouse": ("warehouse_id",),
    "branch": ("branch_id",),
    "employee": ("employee_id",),
    "customer": ("customer_id",),
    "supplier": ("supplier_id",),
    "product": ("product_id",),
    "purchase": ("purchase_id",),
    "payment": ("payment_id",),
    "sale": ("sale_id",),
    "transfer": ("transfer_id",),
    "warehouse_stock": ("warehouse_id", "product_id"),
    "branch_stock": ("branch_id", "product_id"),
}

# Keys of the line tables.  They are given when lines are stored (operators.lines); tables without them have
# no such column.
LINE_KEYS: dict[str, str] = {
    "purchase_detail": "purchase_detail_id",
    "sale_detail": "sale_detail_id",
    "transfer_detail": "transfer_detail_id",
}


def schema_of(name: str, keyed: bool = False) -> T.StructType:
    """Schema of a table; of a line table on request with its key."""
    key = LINE_KEYS.get(name) if keyed else None
    return T.StructType([*SCHEMAS[name].fields, T.StructField(key, ID, True)]) if key else SCHEMAS[name]


# Foreign keys of the data model: (child table, child column, parent table, parent column).
FOREIGN_KEYS: tuple[tuple[str, str, str, str], ...] = (
    ("employee", "warehouse_id", "warehouse", "warehouse_id"),
    ("employee", "branch_id", "branch", "branch_id"),
    ("purchase", "employee_id", "employee", "employee_id"),
    ("purchase", "warehouse_id", "warehouse", "warehouse_id"),
    ("purchase", "supplier_id", "supplier", "supplier_id"),
    ("purchase_detail", "purchase_id", "purchase", "purchase_id"),
    ("purchase_detail", "product_id", "product", "product_id"),
    ("payment", "purchase_id", "purchase", "purchase_id"),
    ("payment", "employee_id", "employee", "employee_id"),
    ("sale", "customer_id", "customer", "customer_id"),
    ("sale", "branch_id", "branch", "branch_id"),
    ("sale", "employee_id", "employee", "employee_id"),
    ("sale_detail", "sale_id", "sale", "sale_id"),
    ("sale_detail", "product_id", "product", "product_id"),
    ("transfer", "warehouse_id", "warehouse", "warehouse_id"),
    ("transfer", "branch_id", "branch", "branch_id"),
    ("transfer", "employee_id", "employee", "employee_id"),
    ("transfer_detail", "transfer_id", "transfer", "transfer_id"),
    ("transfer_detail", "product_id", "product", "product_id"),
    ("warehouse_stock", "warehouse_id", "warehouse", "warehouse_id"),
    ("warehouse_stock", "product_id", "product", "product_id"),
    ("branch_stock", "branch_id", "branch", "branch_id"),
    ("branch_stock", "product_id", "product", "product_id"),
)

# Columns declared NOT NULL by the data model besides the primary keys: only the
# stock quantity (default 0); every other column is nullable.
NOT_NULL: dict[str, tuple[str, ...]] = {
    "warehouse_stock": ("quantity",),
    "branch_stock": ("quantity",),
}
