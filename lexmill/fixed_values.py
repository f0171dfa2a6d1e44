"""Texts, limits and patterns that results must carry exactly.

Nothing here is logic. The Vietnamese texts are what a reader of the results
sees, so they are kept letter by letter.
"""

# --- fixed values: white space that trimming removes -------------------------
TRIM_CHARS = (
    "\t\n\v\f\r \u00A0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200A"
    "\u2028\u2029\u202F\u205F\u3000\uFEFF"
)
SPACE_CLASS = r"[\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

# --- fixed values: sizes and limits ------------------------------------------
CHUNK_MAX_LENGTH = 800
CHUNK_MIN_LENGTH = 50
TEXT_MIN_LENGTH = 10
VECTOR_DIMENSION = 3072
UPSERT_BATCH = 50
TOP_K = 5
RETENTION_DAYS = 30
RATE_LIMIT = 60
RATE_WINDOW = "1 minute"
MAX_FILES = 30
MAX_PAGE_IMAGE_CHARS = 3_000_000
MAX_PAGE_NAME_CHARS = 260
BOX_LIMIT = 1.001
PREVIEW_CHARS = 200
PDF_LINE_TOLERANCE = 2.0
PDF_SPACE_GAP = 1.5
SAFE_SCORE = 80

# --- fixed values: chunk and hit defaults ------------------------------------
CHUNK_DEFAULTS = {
    "title": "Không có tiêu đề",
    "document_type": "Văn bản",
    "source_url": "Không có link",
}
HIT_DEFAULTS = {
    "title": "Tài liệu Pháp luật",
    "content": "Nội dung không khả dụng",
    "source_url": "#",
}
SOURCE_DEFAULT = "Cơ sở dữ liệu nội bộ"

# --- fixed values: retrieved context -----------------------------------------
CHAT_ITEM = "[TÀI LIỆU %d]: %s\nNội dung: %s"
CHAT_SEPARATOR = "\n\n"
CHAT_EMPTY = "Không có dữ liệu văn bản cụ thể. Hãy trả lời dựa trên kiến thức pháp luật chung."
LAW_ITEM = "Nguồn: %s\nNội dung: %s"
LAW_SEPARATOR = "\n---\n"

# --- fixed values: risk rules and scores -------------------------------------
SCORE_CLEAN = 82
SCORE_STEP = 12
SCORE_FLOOR = 45
RISK_RULES = (
    (
        1,
        ("phạt",),
        "Điều khoản phạt vi phạm",
        "Cần kiểm tra mức phạt có vượt giới hạn pháp luật hoặc gây bất lợi quá mức cho một bên hay không.",
        "Medium",
    ),
    (
        2,
        ("đơn phương chấm dứt",),
        "Điều khoản đơn phương chấm dứt",
        "Cần rà soát điều kiện chấm dứt, nghĩa vụ báo trước và bồi thường để tránh tranh chấp.",
        "High",
    ),
    (
        3,
        ("đặt cọc", "thanh toán"),
        "Điều khoản đặt cọc/thanh toán",
        "Nên làm rõ thời hạn, phương thức thanh toán và điều kiện hoàn trả để hạn chế rủi ro.",
        "Medium",
    ),
)
RISK_NONE = (
    "Tổng quan hợp đồng",
    "Chưa phát hiện điều khoản rủi ro nổi bật bằng bộ phân tích tạm thời. "
    "Nên kiểm tra thêm điều khoản thanh toán, chấm dứt, phạt vi phạm và bồi thường.",
    "Low",
)
RULES_SUMMARY = (
    "Hệ thống đang dùng chế độ phân tích tạm thời do chưa kết nối được dịch vụ AI hoặc khóa Gemini. "
    "Kết quả này chỉ mang tính tham khảo để bạn tiếp tục thao tác giao diện."
)
RULES_RECOMMENDATION = (
    "Khi cấu hình xong Gemini và cơ sở dữ liệu, bạn nên chạy phân tích lại để có kết quả pháp lý chi tiết hơn."
)
IMAGE_SCORE = 50
IMAGE_SUMMARY = (
    "Không thể trích xuất nội dung hợp đồng từ ảnh. "
    "Gemini chưa được cấu hình và OCR cục bộ không sẵn sàng trên máy chủ hiện tại."
)
IMAGE_RISK = (
    "Tài liệu dạng ảnh",
    "Vui lòng cấu hình GEMINI_API_KEY để OCR + phân tích chính xác; "
    "hoặc cài đặt môi trường để OCR cục bộ (Transformers.js) có thể tải model.",
    "Medium",
)
IMAGE_RECOMMENDATION = (
    "Nếu cần kết quả ngay, hãy tải lên file PDF/DOCX/TXT; hoặc cấu hình Gemini để hỗ trợ OCR ảnh."
)
MODEL_FAILURE = {
    "summary": "Lỗi kết nối AI.",
    "risk_score": 0,
    "risk": ("Hệ thống", "Hết hạn mức API miễn phí hoặc đang quá tải.", "High"),
    "recommendation": "Vui lòng chờ 15 giây rồi kiểm tra lại.",
}

# --- fixed values: labels ------------------------------------------------------
BADGE_HIGH = "NGHIÊM TRỌNG"
BADGE_MEDIUM = "CẢNH BÁO"
BADGE_OTHER = "LƯU Ý"
DETAIL_OTHER = "Lưu ý"
BADGE_SAFE = "AN TOÀN"
BADGE_RISKY = "RỦI RO"
SLICE_SAFE = "An toàn"
SLICE_RISK = "Rủi ro"
IMAGE_BATCH_NAME = "Ảnh hợp đồng (%d trang)"
EXPORT_TITLE = "Hồ sơ #%d"
EXPORT_CREATED = "Ngày tạo: "
EXPORT_CATEGORY = "Danh mục: "
EXPORT_DESCRIPTION = "Mô tả: "
EXPORT_HEADING = "Nội dung hợp đồng"
EXPORT_EMPTY = "(Chưa có nội dung hợp đồng được lưu)"

# --- fixed values: file kinds --------------------------------------------------
MIME_PDF = "application/pdf"
MIME_DOC = "application/msword"
MIME_DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
MIME_TXT = "text/plain"
UPLOAD_EXTENSIONS = ("pdf", "txt", "doc", "docx", "png", "jpg", "jpeg", "webp")

# --- fixed values: two sample documents shown when no table is available --------
SAMPLE_DOCUMENTS = (
    (
        1,
        "Bộ luật Dân sự 2015",
        "BỘ LUẬT",
        "91/2015/QH13",
        "Bộ luật",
        "Quốc hội",
        "2015-11-24",
        "Văn bản mẫu tạm thời khi hệ thống chưa kết nối được cơ sở dữ liệu.",
        "Nội dung văn bản mẫu để giao diện tra cứu vẫn chạy được trong chế độ offline.",
    ),
    (
        2,
        "Luật Thương mại 2005",
        "LUẬT",
        "36/2005/QH11",
        "Luật",
        "Quốc hội",
        "2005-06-14",
        "Dữ liệu mẫu dự phòng cho module văn bản pháp luật.",
        "Hệ thống đang dùng dữ liệu mẫu vì SQL Server chưa sẵn sàng.",
    ),
)
