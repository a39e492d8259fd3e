"""Declared columns of the four source tables and their types."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: source columns in file order, with the type each gets --
ORDER = {
    "order_id": "string",
    "order_no": "string",
    "customer_id": "string",
    "shop_id": "string",
    "order_time": "time",
    "order_status": "string",
    "order_amount": "money",
    "coupon_amount": "money",
    "freight_amount": "money",
    "payable_amount": "money",
    "order_channel": "string",
    "receiver_province_code": "string",
    "receiver_province_name": "string",
    "updated_at": "time",
}
ORDER_DETAIL = {
    "order_detail_id": "string",
    "order_id": "string",
    "product_id": "string",
    "quantity": "int",
    "unit_price": "money",
    "discount_amount": "money",
    "actual_amount": "money",
    "created_at": "time",
}
CUSTOMER = {
    "customer_id": "string",
    "customer_name": "string",
    "gender": "string",
    "age": "int",
    "phone": "string",
    "email": "string",
    "register_time": "time",
    "member_level": "string",
    "province_code": "string",
    "province_name": "string",
    "customer_status": "string",
    "updated_at": "time",
}
PRODUCT = {
    "product_id": "string",
    "product_name": "string",
    "category_id": "string",
    "category_name": "string",
    "brand_name": "string",
    "unit_price": "money",
    "cost_price": "money",
    "product_status": "string",
    "created_at": "time",
    "updated_at": "time",
}
TABLES = {"order": ORDER, "order_detail": ORDER_DETAIL, "customer": CUSTOMER, "product": PRODUCT}
KEYS = {
    "order": "order_id",
    "order_detail": "order_detail_id",
    "customer": "customer_id",
    "product": "product_id",
}


def text_schema(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
