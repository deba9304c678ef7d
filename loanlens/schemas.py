"""Declared schemas and the fixed vocabularies of the scoring application.

Everything in the "fixed values" blocks must stay exactly as written: these
strings, thresholds and defaults define the results users compare against.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Raw tables (declared, never inferred)
# ---------------------------------------------------------------------------
APPLICATION_SCHEMA = T.StructType([
    T.StructField("SK_ID_CURR", T.LongType(), False),
    T.StructField("TARGET", T.IntegerType(), True),
    T.StructField("DAYS_BIRTH", T.IntegerType(), True),
    T.StructField("DAYS_EMPLOYED", T.IntegerType(), True),
    T.StructField("AMT_INCOME_TOTAL", T.DoubleType(), True),
    T.StructField("AMT_CREDIT", T.DoubleType(), True),
    T.StructField("AMT_ANNUITY", T.DoubleType(), True),
    T.StructField("AMT_GOODS_PRICE", T.DoubleType(), True),
    T.StructField("CNT_CHILDREN", T.IntegerType(), True),
    T.StructField("NAME_EDUCATION_TYPE", T.StringType(), True),
    T.StructField("NAME_HOUSING_TYPE", T.StringType(), True),
    T.StructField("EXT_SOURCE_1", T.DoubleType(), True),
    T.StructField("EXT_SOURCE_2", T.DoubleType(), True),
    T.StructField("EXT_SOURCE_3", T.DoubleType(), True),
])

BUREAU_SCHEMA = T.StructType([
    T.StructField("SK_ID_CURR", T.LongType(), False),
    T.StructField("CREDIT_ACTIVE", T.StringType(), True),
    T.StructField("CREDIT_DAY_OVERDUE", T.IntegerType(), True),
    T.StructField("AMT_CREDIT_SUM", T.DoubleType(), True),
    T.StructField("AMT_CREDIT_SUM_DEBT", T.DoubleType(), True),
])

PREVIOUS_SCHEMA = T.StructType([
    T.StructField("SK_ID_PREV", T.LongType(), True),
    T.StructField("SK_ID_CURR", T.LongType(), False),
    T.StructField("NAME_CONTRACT_STATUS", T.StringType(), True),
])

# ---------------------------------------------------------------------------
# Model feature columns, in the order the model consumes them.
# ---------------------------------------------------------------------------
FEATURES = [
    "applicant_age", "income_total", "employment_years",
    "loan_amount", "loan_annuity", "goods_price",
    "num_children", "NAME_EDUCATION_TYPE", "NAME_HOUSING_TYPE",
    "bureau_loans_active", "bureau_overdue_count",
    "prev_application_count", "prev_approved_ratio",
    "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3",
    "loan_to_income_ratio", "annuity_to_income_ratio",
    "credit_to_goods_ratio", "external_source_mean", "external_source_std",
    "income_per_person", "payment_rate", "bureau_debt_to_credit_ratio",
]
CATEGORICAL = ["NAME_EDUCATION_TYPE", "NAME_HOUSING_TYPE"]
EXT_SOURCES = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]

# Raw application column -> model column.
RAW_TO_MODEL = {
    "AMT_INCOME_TOTAL": "income_total",
    "AMT_CREDIT": "loan_amount",
    "AMT_ANNUITY": "loan_annuity",
    "AMT_GOODS_PRICE": "goods_price",
    "CNT_CHILDREN": "num_children",
}

# Request field -> model column.
REQUEST_TO_MODEL = {
    "education_type": "NAME_EDUCATION_TYPE",
    "housing_type": "NAME_HOUSING_TYPE",
    "external_source_1": "EXT_SOURCE_1",
    "external_source_2": "EXT_SOURCE_2",
    "external_source_3": "EXT_SOURCE_3",
}

DAYS_EMPLOYED_SENTINEL = 365243  # fixed value: "not employed" marker
UNKNOWN_LABEL = "Unknown"        # fixed value: label for missing categories

# ---------------------------------------------------------------------------
# Loan-application request (16 fields)
# ---------------------------------------------------------------------------
REQUEST_SCHEMA = T.StructType([
    T.StructField("applicant_age", T.DoubleType(), True),
    T.StructField("income_total", T.DoubleType(), True),
    T.StructField("employment_years", T.DoubleType(), True),
    T.StructField("loan_amount", T.DoubleType(), True),
    T.StructField("loan_annuity", T.DoubleType(), True),
    T.StructField("goods_price", T.DoubleType(), True),
    T.StructField("num_children", T.IntegerType(), True),
    T.StructField("education_type", T.StringType(), True),
    T.StructField("housing_type", T.StringType(), True),
    T.StructField("bureau_loans_active", T.IntegerType(), True),
    T.StructField("bureau_overdue_count", T.IntegerType(), True),
    T.StructField("prev_application_count", T.IntegerType(), True),
    T.StructField("prev_approved_ratio", T.DoubleType(), True),
    T.StructField("external_source_1", T.DoubleType(), True),
    T.StructField("external_source_2", T.DoubleType(), True),
    T.StructField("external_source_3", T.DoubleType(), True),
])
REQUEST_FIELDS = [f.name for f in REQUEST_SCHEMA.fields]

# Validation of requests -- required fields and (lo, hi) bounds
# (None = unbounded), and the defaults of optional fields.
REQUIRED_FIELDS = ["applicant_age", "income_total", "employment_years",
                   "loan_amount", "loan_annuity", "goods_price"]
FIELD_RANGES = {
    "applicant_age": (18, 100),
    "income_total": (0, None),
    "employment_years": (0, 80),
    "loan_amount": (0, None),
    "loan_annuity": (0, None),
    "goods_price": (0, None),
    "num_children": (0, None),
    "bureau_loans_active": (0, None),
    "bureau_overdue_count": (0, None),
    "prev_application_count": (0, None),
    "prev_approved_ratio": (0, 1),
    "external_source_1": (0, 1),
    "external_source_2": (0, 1),
    "external_source_3": (0, 1),
}
REQUEST_DEFAULTS = {
    "num_children": 0,
    "education_type": "Higher education",
    "housing_type": "House / apartment",
    "bureau_loans_active": 0,
    "bureau_overdue_count": 0,
    "prev_application_count": 0,
    "prev_approved_ratio": 0.0,
}

# Defaults the online feature builder uses for absent fields.
ONLINE_DEFAULTS = {
    "applicant_age": 30.0,
    "income_total": 50000.0,
    "employment_years": 2.0,
    "loan_amount": 100000.0,
    "loan_annuity": 5000.0,
    "goods_price": 100000.0,
    "num_children": 0,
    "bureau_loans_active": 0.0,
    "bureau_overdue_count": 0.0,
    "bureau_debt_to_credit_ratio": 0.0,
    "prev_application_count": 0.0,
    "prev_approved_ratio": 0.0,
}

# ---------------------------------------------------------------------------
# Decision grades (upper bound of probability, inclusive),
# actions, colours and descriptions.
# ---------------------------------------------------------------------------
GRADES = ["Excellent", "Good", "Fair", "Poor"]
GRADE_TABLE = [
    # grade, max probability, action, colour, description
    ("Excellent", 0.10, "AUTO_APPROVE", "#10b981",
     "Hồ sơ tín dụng cực kỳ tốt. Hệ thống đề xuất DUYỆT TỰ ĐỘNG khoản vay."),
    ("Good", 0.25, "APPROVE_WITH_CONDITIONS", "#3b82f6",
     "Khách hàng có lịch sử tín dụng khá. Đề xuất duyệt vay kèm các điều khoản/giám sát bổ sung."),
    ("Fair", 0.50, "MANUAL_REVIEW", "#f59e0b",
     "Hồ sơ tín dụng ở mức trung bình. Đề xuất chuyển sang bộ phận thẩm định thủ công để xem xét kỹ."),
    ("Poor", 1.00, "REJECT", "#ef4444",
     "Tỷ lệ rủi ro vỡ nợ quá cao. Hệ thống đề xuất TỪ CHỐI DUYỆT khoản vay."),
]
SCORE_MAX = 850   # fixed value
SCORE_SPAN = 550  # fixed value: score = 850 - floor(p * 550)

# Display names of features in explanations (others keep their name).
DISPLAY_NAMES = {
    "applicant_age": "Tuổi khách hàng",
    "income_total": "Thu nhập hàng tháng",
    "employment_years": "Số năm làm việc",
    "loan_amount": "Số tiền xin vay",
    "loan_annuity": "Số tiền trả góp định kỳ",
    "goods_price": "Giá trị tài sản mua",
    "num_children": "Số con cái",
    "NAME_EDUCATION_TYPE": "Trình độ học vấn",
    "NAME_HOUSING_TYPE": "Hình thức cư trú",
    "bureau_loans_active": "Số khoản vay CIC đang hoạt động",
    "bureau_overdue_count": "Số khoản nợ CIC quá hạn",
    "prev_application_count": "Số hồ sơ vay cũ tại Home Credit",
    "prev_approved_ratio": "Tỷ lệ duyệt hồ sơ cũ",
    "EXT_SOURCE_1": "Điểm tín dụng đối tác 1",
    "EXT_SOURCE_2": "Điểm tín dụng đối tác 2",
    "EXT_SOURCE_3": "Điểm tín dụng đối tác 3",
    "loan_to_income_ratio": "Tỷ lệ nợ/thu nhập",
    "annuity_to_income_ratio": "Tỷ lệ trả góp/thu nhập",
    "credit_to_goods_ratio": "Tỷ lệ vay/trị giá hàng hóa",
    "external_source_mean": "Điểm tín dụng TB đối tác",
    "external_source_std": "Độ lệch điểm tín dụng",
}

# Explanation sentences ({name}, {magnitude} with 3 decimals).
FACTOR_TEXT_INCREASE = "Chỉ số {name} làm tăng nguy cơ nợ xấu (mức độ ảnh hưởng: +{magnitude})."
FACTOR_TEXT_DECREASE = "Chỉ số {name} giúp giảm thiểu nguy cơ nợ xấu (mức độ ảnh hưởng: -{magnitude})."
APPLICANT_NAME_PREFIX = "Khách hàng "  # fixed value: mock applicant name prefix

# Monitoring thresholds and texts.
POOR_RATE_ALERT = 0.35
HIGH_DEFAULT_ALERT = "HIGH_DEFAULT_RATE_DETECTED"
DRIFT_P_THRESHOLD = 0.05
DRIFT_SHARE_THRESHOLD = 0.5
DRIFT_MIN_ROWS = 10
PSI_BANDS = (0.1, 0.25)  # < 0.1 STABLE, 0.1..0.25 WATCH, > 0.25 DRIFTED
DRIFT_RECOMMENDATIONS = {
    "dataset": "Cảnh báo: Phát hiện sự lệch dữ liệu trên hệ thống (Dataset Drift). Đề nghị thu thập thêm mẫu và chuẩn bị huấn luyện lại mô hình.",
    "some": "Một số thuộc tính đầu vào quan trọng có sự lệch nhẹ. Cần tiếp tục theo dõi các chỉ số.",
    "stable": "Hệ thống hoạt động ổn định. Phân phối dữ liệu thực tế khớp tốt với dữ liệu huấn luyện.",
    "not_enough": "Chưa đủ dữ liệu thực tế để so sánh. Cần thực hiện tối thiểu 10 lượt chấm điểm tín dụng (hiện có: {n}).",
    # the reference's text names its own training script; ours names our writer
    "no_reference": "Lỗi: Không tìm thấy tệp reference_data.parquet. Cần huấn luyện và ghi mẫu chuẩn "
                    "(loanlens.sources.write_reference) để xuất tệp chuẩn.",
}

# Exploratory bins.
AGE_BIN_EDGES = [20, 30, 40, 50, 60, 70]
AGE_BIN_LABELS = ["20-30", "30-40", "40-50", "50-60", "60-70"]
PAYMENT_RATE_LABELS = ["Rất Thấp", "Thấp", "Trung Bình", "Cao", "Rất Cao"]

# Log view used by drift: log column -> model column (19 features + TARGET).
LOG_TO_DRIFT = {
    "applicant_age": "applicant_age",
    "income_total": "income_total",
    "employment_years": "employment_years",
    "loan_amount": "loan_amount",
    "loan_annuity": "loan_annuity",
    "goods_price": "goods_price",
    "num_children": "num_children",
    "education_type": "NAME_EDUCATION_TYPE",
    "housing_type": "NAME_HOUSING_TYPE",
    "bureau_loans_active": "bureau_loans_active",
    "bureau_overdue_count": "bureau_overdue_count",
    "prev_application_count": "prev_application_count",
    "prev_approved_ratio": "prev_approved_ratio",
    "external_source_1": "EXT_SOURCE_1",
    "external_source_2": "EXT_SOURCE_2",
    "external_source_3": "EXT_SOURCE_3",
    "loan_to_income_ratio": "loan_to_income_ratio",
    "annuity_to_income_ratio": "annuity_to_income_ratio",
    "credit_to_goods_ratio": "credit_to_goods_ratio",
    "default_probability": "TARGET",
}

RISK_FACTOR_TYPE = T.ArrayType(T.StructType([
    T.StructField("feature", T.StringType()),
    T.StructField("display_name", T.StringType()),
    T.StructField("shap_value", T.DoubleType()),
    T.StructField("direction", T.StringType()),
    T.StructField("description", T.StringType()),
]))


# Label of each recommended action as the user interface shows it.
ACTION_LABELS = {
    "AUTO_APPROVE": "PHÊ DUYỆT TỰ ĐỘNG",
    "APPROVE_WITH_CONDITIONS": "DUYỆT CÓ ĐIỀU KIỆN",
    "MANUAL_REVIEW": "THẨM ĐỊNH THỦ CÔNG",
    "REJECT": "TỪ CHỐI CHO VAY",
}
