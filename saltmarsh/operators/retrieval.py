"""Chunks of texts, and routing of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from saltmarsh.functions.text import stripped

THRESHOLD, MARGIN = 0.40, 0.05
#: Routes with words that decide at once, in this order. Fixed values.
KEYWORDS = (
    (
        "EXPLAIN",
        r"^\s*(vì sao|tại sao|vi sao|tai sao|sao lại|lý do|ly do)|giải thích (giúp|cho|thêm|rõ)|giai thich|dựa (vào|trên) (đâu|cơ sở nào)|căn cứ nào|(sao|vì sao).{0,20}(chọn|cao|thấp|đắt|rẻ) (hơn|thế|vậy)",
    ),
    (
        "REPORT",
        r"(báo cáo|bao cao|phân tích|phan tich|tổng kết|tong ket).{0,30}(quý|quy \d|nửa năm|nua nam|cả năm|ca nam|năm nay|năm ngoái|kỳ)|(lãi|lỗ|lợi nhuận|loi nhuan|lai lo)|(doanh thu|chi phí|chi phi).{0,25}(quý|nửa năm|cả năm|theo (kỳ|quý|năm))|mặt hàng nào (lãi|lời|có lãi|sinh lời)|(so sánh|so sanh).{0,20}(quý|kỳ|năm)",
    ),
    (
        "LOGISTICS",
        r"báo giá|bao gia|giá cước|cước phí|cước vận|xe\s*\d+([.,]\d+)?\s*(tấn|t\b)|đầu kéo|dau keo|container|cont\b|(chuyến|chuyen)\s+(xe|hàng)|thuê xe|gọi xe.*(tải|tấn)",
    ),
    (
        "TECHNICAL",
        r"(tạo|lập|thiết lập|setup|xây dựng|lên)\s+.{0,20}(quy trình|workflow|tự động|automation|lịch chạy)|workflow|n8n|(tự động|định kỳ|mỗi (ngày|tuần|tháng|giờ|tiếng|sáng|tối))\s+.{0,30}(gửi|báo|cảnh báo|thông báo|đồng bộ|xuất|kiểm tra)",
    ),
    ("RETRIEVAL", r"thuế|vat|gtgt|hoá đơn đỏ|hóa đơn đỏ|nghị định|thông tư|luật|quy định|điều khoản|chính sách (đổi|trả|bảo hành|hoàn)|hướng dẫn (sử dụng|tạo|cấu hình)"),
)


def chunk_words(df: DataFrame, text: str = "text", size: int = 150, overlap: int = 30) -> DataFrame:
    """Overlapping chunks of words: one begins every size - overlap words while there are any."""
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    starts = F.when(F.size("_w") > 0, F.sequence(F.lit(1), F.size("_w"), F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    rows = df.withColumn("_w", words).select("*", F.posexplode(starts).alias("chunk", "_start"))
    return rows.withColumn("chunk_text", F.array_join(F.slice("_w", F.col("_start"), F.lit(size)), " ")).drop("_w", "_start")


def chunk_chars(df: DataFrame, text: str = "text", size: int = 1200, overlap: int = 150, least: int = 100) -> DataFrame:
    """Overlapping chunks of characters, trimmed, those of more than ``least``; shorter texts give none."""
    n = F.length(text)
    starts = F.when(n >= least, F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    rows = df.select("*", F.explode(starts).alias("_start")).withColumn("chunk_text", stripped(F.substring(F.col(text), F.col("_start"), F.lit(size))))
    return rows.filter(F.length("chunk_text") > least).withColumn("chunk", ((F.col("_start") - 1) / (size - overlap)).cast("int")).drop("_start")


def keyword_route(text: Column) -> Column:
    """The first route whose words are in the text; null without any."""
    out = F.lit(None).cast("string")
    for route, pattern in reversed(KEYWORDS):
        out = F.when(text.rlike(f"(?iu){pattern}"), route).otherwise(out)
    return out


def semantic_route(similarities: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """Route of each query from (query_id, route, similarity, keyword): its keyword route, else the most similar one.

    GENERAL where the best similarity is below ``threshold`` or less than ``margin`` above the next route's.
    """
    best = similarities.groupBy("query_id", "route").agg(F.max("similarity").alias("sim"), F.max("keyword").alias("keyword"))
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "route")
    first = best.withColumn("next", F.coalesce(F.lead("sim").over(order), F.lit(0.0))).withColumn("r", F.row_number().over(order)).filter("r = 1")
    gap = F.round(F.col("sim") - F.col("next"), 4)
    method = F.when(F.col("keyword").isNotNull(), "keyword").when(F.col("sim") < threshold, "below_threshold").when(gap < margin, "narrow_margin").otherwise("semantic")
    rows = first.select("query_id", "keyword", "route", F.round("sim", 4).alias("sim"), gap.alias("gap"), method.alias("method"))
    route = F.when(F.col("method") == "keyword", F.col("keyword")).when(F.col("method") == "semantic", F.col("route")).otherwise("GENERAL")
    return rows.select("query_id", route.alias("category"), F.when(F.col("method") == "keyword", F.lit(1.0)).otherwise(F.col("sim")).alias("score"), "gap", "method")
