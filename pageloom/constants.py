"""Fixed values shared by the operators.

Everything here is data that decides results (marker strings, word lists,
dictionaries, default thresholds); logic lives in the other modules.
"""

# -- markers found in target texts (fixed values) ---------------------------
FAILURE_MARKER = "[翻译失败]"
ERASE_ONLY = "[INPAINT_ONLY]"
SFX_PREFIX = "[SFX:"

# -- labels of skip / noise reasons (fixed values) ---------------------------
REASON_EMPTY = "空文本"
REASON_DIGITS = "纯数字/符号"
REASON_ROMAN = "罗马数字"
REASON_SYMBOL = "符号噪声"
REASON_CAPS = "短大写缩写"
REASON_ALNUM = "短字母数字"
REASON_SHORT_DIGITS = "短数字"
REASON_SPACED_DIGITS = "分隔数字"

# -- regular expression pieces, valid for Java regex --------------------------
WS = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\p{Z}]"
NOT_WS = r"[^\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\p{Z}]"
HANGUL = r"\x{AC00}-\x{D7A3}"
HANGUL_WIDE = r"\x{AC00}-\x{D7A3}\x{3130}-\x{318F}\x{1100}-\x{11FF}"
KANA = r"\x{3040}-\x{30FF}"
CJK = r"\x{4E00}-\x{9FFF}"
ROMAN = r"\x{2160}-\x{2188}"
TRAIL_PUNCT = "!！?？….,。"
# letters whose upper-case form starts with a letter from A to Z
LATIN_LETTERS = (
    r"A-Za-z\x{DF}\x{131}\x{17F}\x{1F0}\x{1E96}-\x{1E9A}\x{FB00}-\x{FB06}"
)

# -- sound effects (fixed values) ---------------------------------------------
SFX_EXCLUSIONS = (
    "TEL", "VIP", "SMS", "ID", "NO", "OK", "TV", "VS", "FM", "AM", "DJ", "MC", "PC",
)
SFX_EN = {
    "BANG": "砰", "BOOM": "轰", "CRASH": "哗啦", "SLASH": "刷", "WHOOSH": "嗖",
    "THUD": "砰", "THUMP": "咚", "CRACK": "咔嚓", "RUMBLE": "隆隆", "SPLASH": "哗",
    "CLICK": "咔哒", "CLACK": "咔", "TAP": "嗒", "RUSTLE": "沙沙", "RATTLE": "喀啦",
}
SFX_KO = {
    "팅": "叮", "딱": "咔", "팡": "砰", "펑": "嘭", "탕": "砰", "쿵": "咚", "쾅": "轰",
    "퍽": "噗", "헉": "哈", "윽": "呃", "흑": "呜", "으악": "啊啊", "후": "呼", "휴": "呼",
    "휙": "嗖", "슥": "唰", "슥슥": "唰唰", "쓱": "唰", "쓱쓱": "唰唰", "파닥": "扑腾",
    "파닥파닥": "扑腾扑腾", "두근두근": "怦怦", "덜컹덜컹": "哐当哐当",
    "철컹철컹": "铛啷铛啷", "우두둑": "噼啪", "잘근": "嚼嚼", "토톡": "哒哒",
    "독토톡도": "哒哒哒", "떠링": "叮", "부들": "颤抖", "무들": "颤抖", "저벅": "踏踏",
    "저벽": "踏踏", "처벽": "踏踏", "중얼": "嘀咕", "큼큼": "咳咳", "e큼큼": "咳咳",
}
SFX_KO_WORDS = (
    "쾅", "쿵", "탕", "펑", "퍽", "두근두근", "덜컹덜컹", "철컹철컹", "우두둑", "슥", "슥슥",
    "쓱", "쓱쓱", "파닥", "파닥파닥", "팡", "딱", "헉", "윽", "흑", "으악", "휴", "후", "휙",
)
SFX_CN_WORDS = (
    "砰", "咔", "咔嚓", "嗖", "嘭", "哗", "呼", "啪", "嘎", "轰", "嘶", "咚", "叮", "嗡",
    "嘀", "哐", "咣", "嘣", "噗", "咻", "唰",
)
SFX_CAPS_WORDS = (
    "BOOM", "BANG", "CRASH", "SLASH", "WHOOSH", "THUD", "CRACK", "THUMP", "SPLASH", "RUMBLE",
)

# -- recognition fix-ups for Korean, applied in this order (fixed values) -----
KO_FIXES = (
    ("이닌", "이번"), ("억은", "역은"), ("닌역", "번역"), ("이아", "이야"), ("운요", "은요"),
)

# -- watermark keywords (fixed values) ----------------------------------------
WATERMARK_KEYWORDS = (
    "mangaforfree", "toongod", "newtoki", "newtok", "manga", "manhua", "comic", "scan",
    "raw", "sub", "copyright", "all rights reserved", "©", "http", "https", ".com", ".net",
    ".org", "뉴토끼", "입분양", "입제공", "사이트",
)

# -- reply hygiene (fixed values) ----------------------------------------------
PROMPT_HINTS = (
    "assistant", "translate", "output only", "numbered", "json", "system prompt",
)
# removed in this order; \b is a word start in the sense of Unicode
ANNOTATIONS = (
    f"(?i)^{WS}*(TEXT|CTX){WS}*[:：]{WS}*",
    f"(?i)\\b(TEXT|CTX){WS}*[:：]{WS}*",
    f"^{WS}*翻译{WS}*[:：]{WS}*",
    f"(?is){WS}*\\(Note:.*?(\\)|\\z)",
    f"(?s){WS}*\\(注[:：].*?(\\)|\\z)",
    f"(?is){WS}*\\(This{WS}+(seems?|means?|appears?).*?(\\)|\\z)",
    f"(?i)Without{WS}+more{WS}+context[,，][^\\n]*?([。.]|\\n?\\z)",
    f"(?i)This{WS}+(seems?|means?|appears?){WS}+to{WS}+be[^\\n]*?([。.]|\\n?\\z)",
    f"(?i)direct{WS}+translation{WS}+might{WS}+not[^\\n]*?([。.]|\\n?\\z)",
)
CHALLENGE_MARKERS = (
    "cf-browser-verification", "challenge-platform", "cloudflare ray id",
    "attention required", "just a moment",
)
OVERLOAD_WORDS = (
    "503", "unavailable", "overload", "overloaded", "timeout", "timed out", "empty response",
)
SPLIT_PUNCT = ("。", "！", "？", "…", "；", "，")
BREAK_CHARS = "，。！？、；：,.:;!? "

# -- language codes (fixed values) ---------------------------------------------
LANG_CODES = {
    "zh": "zh-CN", "zh-cn": "zh-CN", "zh-hans": "zh-CN", "zh-tw": "zh-TW",
    "zh-hant": "zh-TW", "korean": "ko", "japanese": "ja", "english": "en",
    "chinese": "zh-CN",
}

# -- sites (fixed values) --------------------------------------------------------
SITE_HOSTS = {"toongod.org": "toongod", "mangaforfree.com": "mangaforfree"}
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp")

# -- reports (fixed values) --------------------------------------------------------
COUNTER_KEYS = (
    "requests_primary", "requests_fallback", "timeouts_primary",
    "fallback_provider_calls", "missing_number_retries",
)
CONFIG_KEYS = (
    "AI_PROVIDER", "PPIO_MODEL", "GEMINI_MODEL", "AI_TRANSLATE_PRIMARY_TIMEOUT_MS",
    "AI_TRANSLATE_ZH_FALLBACK_BATCH", "AI_TRANSLATE_BATCH_CHUNK_SIZE",
    "AI_TRANSLATE_BATCH_CONCURRENCY", "AI_TRANSLATE_MAX_INFLIGHT_CALLS",
    "AI_TRANSLATE_FASTFAIL", "OCR_TILE_HEIGHT", "OCR_TILE_OVERLAP_RATIO",
    "OCR_EDGE_TILE_MODE", "UPSCALE_ENABLE",
)
SECRET_WORDS = ("KEY", "TOKEN", "PASSWORD", "SECRET")
STAGE_INDEX = {
    "init": 0, "ocr": 1, "translator": 2, "inpainter": 3, "renderer": 4, "upscaler": 5,
    "complete": 6, "failed": 6,
}

# -- request paths that only probes ask for (fixed values) ------------------------
PROBE_PATH = (
    r"^/(?:\.env(?:\..*)?|\.git(?:/.*)?|hiddenbin(?:/.*)?|phpmyadmin(?:/.*)?|wp-admin(?:/.*)?|cgi-bin(?:/.*)?"
    r"|HNAP1(?:/.*)?|boaform(?:/.*)?|vendor/phpunit(?:/.*)?|server-status(?:/.*)?|\.DS_Store|actuator(?:/.*)?"
    r"|jmx-console(?:/.*)?|manager/html(?:/.*)?)(?:\?.*)?\z"
)

# -- image lists in scripts (fixed values) ----------------------------------------
SCRIPT_ARRAYS = (
    r"(?s)chapter_preloaded_images\s*=\s*(\[[^\]]+\])", r"(?s)chapter_images\s*=\s*(\[[^\]]+\])", r"(?s)images\s*:\s*(\[[^\]]+\])",
)

# -- HTML fields (fixed values) -----------------------------------------------------
ARTICLE_TYPES = ("Article", "NewsArticle", "BlogPosting", "Report", "CreativeWork")
META_PRIORITY = {
    "title": ("property=og:title", "name=twitter:title", "name=title"),
    "author": ("name=author", "property=article:author"),
    "date": (
        "property=article:published_time", "property=article:modified_time",
        "name=pubdate", "name=date", "itemprop=datePublished",
    ),
    "summary": ("name=description", "property=og:description", "name=twitter:description"),
    "cover": ("property=og:image", "name=twitter:image", "itemprop=image"),
}
BOILERPLATE_TAGS = (
    "script", "style", "noscript", "header", "footer", "nav", "aside", "form", "iframe",
)
BLOCK_TAGS = ("article", "main", "section", "div")
LAZY_ATTRS = (
    "src", "data-src", "data-original", "data-lazy", "data-url", "data-srcset",
    "data-original-src", "data-lazy-src",
)
COVER_ATTRS = (
    "data-src", "data-original", "data-lazy", "data-srcset", "data-lazy-src",
    "data-original-src", "srcset", "src",
)

# fixed values: URL schemes whose references are resolved, and those of them with ;parameters
RELATIVE_SCHEMES = (
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms", "prospero", "rtsp", "rtsps",
    "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss",
)
PARAMETER_SCHEMES = ("", "ftp", "prospero", "http", "imap", "https", "shttp", "rtsp", "rtsps", "rtspu", "mms", "sftp")
