"""Fixed business values.

These are the values results must carry exactly; nothing here is logic.
"""

from __future__ import annotations

# ---- fixed values: order life cycle -------------------------------------
ORDER_STATUSES = ("待支付", "已支付", "已发货", "已完成", "已取消", "已退款")
VALID_SALES_STATUSES = ("已支付", "已发货", "已完成")
ORDER_CHANNELS = ("APP", "小程序", "PC", "线下")

# ---- fixed values: names given to missing dimension members --------------
UNKNOWN_CUSTOMER = "未知客户"
UNKNOWN_PRODUCT_ID = "UNKNOWN_PRODUCT"
UNKNOWN_PRODUCT = "未知商品"
UNKNOWN_CATEGORY = "未知分类"
UNKNOWN_AREA_CODE = "UNKNOWN"
UNKNOWN_AREA = "未知地区"

# ---- fixed values: user levels by total amount ---------------------------
VIP_AMOUNT = 10000
IMPORTANT_AMOUNT = 5000
LEVEL_VIP = "VIP"
LEVEL_IMPORTANT = "重点用户"
LEVEL_NORMAL = "普通用户"

# ---- fixed values: RFM segments by (R high, F high, M high) --------------
RFM_HIGH_SCORE = 4
RFM_SEGMENTS = {
    (True, True, True): "重要价值用户",
    (False, True, True): "重要保持用户",
    (True, False, True): "重要发展用户",
    (False, False, True): "重要挽留用户",
    (True, True, False): "一般价值用户",
    (False, True, False): "一般保持用户",
    (True, False, False): "一般发展用户",
    (False, False, False): "一般挽留用户",
}
RFM_UNCLASSIFIED = "未分类"

# ---- fixed values: product classes by running share in percent -----------
ABC_LEVELS = (("A类", 80), ("B类", 95))
ABC_REST = "C类"

# ---- fixed values: weekday names, Monday first ---------------------------
WEEKDAY_NAMES = ("星期一", "星期二", "星期三", "星期四", "星期五", "星期六", "星期日")

# ---- fixed values: technical columns and formats -------------------------
SOURCE_SYSTEM = "ecommerce"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
TIME_PATTERN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"
BATCH_FORMAT = "yyyyMMddHHmmss"
MONTH_FORMAT = "yyyy-MM"
MONTH_PATTERN = r"\d{4}-\d{2}"

# ---- fixed values: quality rules -----------------------------------------
RULE_WEIGHTS = {
    "NullRule": 30,
    "DuplicateRule": 20,
    "TypeRule": 20,
    "BusinessRule": 20,
    "AmountRule": 10,
}
RULE_SEVERITY = {
    "NullRule": "HIGH",
    "BusinessRule": "HIGH",
    "AmountRule": "MEDIUM",
    "DuplicateRule": "MEDIUM",
    "TypeRule": "HIGH",
}
DEFAULT_SEVERITY = "LOW"
QUALITY_LEVELS = (("A级", 90), ("B级", 80), ("C级", 60))
QUALITY_REST = "D级"
PENALTY_PER_ERROR = "0.1"
MIN_ORDER_ROWS = 5000
QUANTITY_RANGE = (1, 5)
AGE_RANGE = (0, 120)
MONEY_TOLERANCE = "0.01"

# ---- fixed values: messages of the rule report ---------------------------
RULE_MESSAGES = {
    "NullRule": ("存在空值", "无空值"),
    "DuplicateRule": ("存在重复数据", "无重复数据"),
    "TypeRule": ("字段类型错误", "字段类型正常"),
    "BusinessRule": ("订单金额异常", "业务校验通过"),
    "AmountRule": ("存在负金额", "金额校验通过"),
    "CountRule": ("数据量异常", "数据量正常"),
}

# ---- fixed values: layout and skew thresholds ----------------------------
SMALL_FILE_COUNT = 10
SMALL_FILE_MB = 1
BROADCAST_MB = 10
SKEW_HOT = 10
SKEW_WATCH = 5
SALT_BUCKETS = 8
