"""Column names of known exports and aliases of canonical columns."""

# Columns that identify a Shopify orders export, and their canonical names.
SHOPIFY_ORDER_MARKERS = {"Name", "Created at", "Financial Status"}
SHOPIFY_ORDERS = {
    "Name": "order_id",
    "Created at": "order_date",
    "Total": "amount",
    "Email": "customer_id",
    "Discount Amount": "discount",
    "Financial Status": "financial_status",
    "Shipping": "shipping",
    "Billing City": "city",
    "Lineitem name": "product_name",
    "Lineitem quantity": "quantity",
    "Lineitem price": "item_price",
    "Lineitem sku": "sku",
}
# The same for a Shopify products export.
SHOPIFY_PRODUCT_MARKERS = {"Handle", "Title", "Variant Price"}
SHOPIFY_PRODUCTS = {
    "Handle": "product_id",
    "Title": "name",
    "Variant Price": "price",
    "Variant SKU": "sku",
    "Vendor": "vendor",
    "Type": "category",
    "Tags": "tags",
    "Variant Inventory Qty": "stock_quantity",
}

# Required columns per table.
REQUIRED = {
    "orders": {"order_id", "order_date", "amount", "customer_id"},
    "products": {"product_id", "name", "price", "category"},
    "inventory": {"sku", "quantity_on_hand"},
}

# Accepted header names per canonical column, first match wins.
ALIASES = {
    "order_id": [
        "order_id", "order id", "order_number", "order number", "invoice", "invoice number",
        "invoice/item number", "transaction_id", "transaction id",
    ],
    "order_date": [
        "order_date", "order date", "date", "created_at", "created at", "purchase_date", "purchase date",
        "transaction_date", "transaction date", "day", "invoicedate", "invoice_date", "invoice date",
    ],
    "amount": [
        "amount", "total", "sale (dollars)", "sale_amount", "sale amount", "total_amount", "total amount",
        "revenue", "grand_total", "grand total", "total sales", "net sales",
    ],
    "customer_id": [
        "customer_id", "customer id", "email", "customer_email", "buyer_id", "store number", "store_number",
        "store name", "user_id", "client_id",
    ],
    "product_name": [
        "product_name", "product name", "item description", "item_description", "product", "item",
        "lineitem name", "product title", "description", "item_name", "item name",
    ],
    "quantity": ["quantity", "bottles sold", "qty", "units", "items", "lineitem quantity"],
    "sku": [
        "sku", "item number", "item_number", "variant_id", "lineitem sku", "stockcode", "stock_code",
        "stock code", "product_code", "product code",
    ],
    "discount": ["discount", "discount_amount", "discount amount", "discounts"],
    "category": ["category", "category name", "category_name", "product_type", "product type"],
    "city": ["city", "billing city", "shipping city"],
    "item_price": ["item_price", "item price", "unit_price", "unit price", "lineitem price", "price"],
}

# Fixed value: what is said of a source without an optional column.
NOTES_WITHOUT = {("orders", "discount"): "'discount' column missing — discount analysis will be skipped"}

# Value type a canonical column should have, bonus for it, least score to map.
EXPECTED_TYPES = {
    "order_id": "id",
    "order_date": "date",
    "amount": "currency",
    "customer_id": "id",
    "discount": "currency",
    "quantity": "currency",
}
TYPE_BONUS = 0.2
LEAST_SCORE = 0.5
# Share of numbers that makes a currency column, share of different values an id.
NUMERIC_FROM = 0.8
DISTINCT_FROM = 0.8

# Date patterns and their shapes.  In a shape ``9`` stands for one or two digits,
# ``99`` for three or four, and so on, ``a`` for a letter.  Where a second pattern is given it
# serves texts whose first number cannot be a month.
DATE_SHAPES = [
    ("M/d/yyyy", "d/M/yyyy", ["9/9/99"]),
    ("M-d-yyyy", "d-M-yyyy", ["9-9-99"]),
    ("M.d.yyyy", "d.M.yyyy", ["9.9.99"]),
    ("M/d/yy", "d/M/yy", ["9/9/9"]),
    ("yyyy/M/d", None, ["99/9/9"]),
    ("yyyyMMdd", None, ["9999"]),
    ("MMM d, yyyy", None, ["aaa 9, 99"]),
    ("MMMM d, yyyy", None, ["a" * n + " 9, 99" for n in range(4, 10)]),
    ("d MMM yyyy", None, ["9 aaa 99"]),
    ("d MMMM yyyy", None, ["9 " + "a" * n + " 99" for n in range(4, 10)]),
]
# Time of day after a date, and its shapes.
CLOCK_SHAPES = [("[ H:mm[:ss]]", ["", " 9:9", " 9:9:9"]), (" h:mm[:ss][ ]a", [" 9:9aa", " 9:9:9aa", " 9:9 aa", " 9:9:9 aa"])]
# Whole timestamps with a zone, and their shapes.
ZONED_SHAPES = [("yyyy-M-d HH:mm:ss Z", ["99-9-9 9:9:9 +99", "99-9-9 9:9:9 -99"]), ("yyyy-M-d HH:mm:ss z", ["99-9-9 9:9:9 aaa"])]
# Fixed value: beginning of ISO date and timestamp texts; a year alone is a number.
ISO_START = r"^\d{4}-\d"
