"""Cleaning, gates and text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that decide which text is kept.
WHITE = "[\\s\\u00A0\\u3000\\uFEFF]"
REMOVED = (
    r"<relevant-memories>[\s\S]*?</relevant-memories>",
    r"<user-persona>[\s\S]*?</user-persona>",
    r"<relevant-scenes>[\s\S]*?</relevant-scenes>",
    r"<scene-navigation>[\s\S]*?</scene-navigation>",
    r"<current_task_context>[\s\S]*?</current_task_context>",
    r"<history_task_context[\s\S]*?</history_task_context>",
    r"(?:Conversation info|Sender|Thread starter|Replied message|Forwarded message context|Chat history since last reply)\s*\(untrusted[\s\S]*?\):\s*```json\s*[\s\S]*?```",
    r'```json\s*\{[\s\S]*?"session[\s\S]*?\}\s*```',
    r"\[\[reply_to[^\]]*\]\]\s*",
    r"¥¥\[[\s\S]*?\]¥¥",
    r"(?m)^\[[\w\d\-:+ ]+\]\s*",
    r"\[media attached:[^\]]*\]\s*",
    r"To send an image back,[\s\S]*?(?:Keep caption in the text body\.)\s*",
    r"(?m)^System:\s*\[[\s\S]*?$",
    r"(?i)data:image/[a-z+]+;base64,[A-Za-z0-9+/=]+",
)
CODE_BLOCK = r"```[^\n]*\n[\s\S]*?```"
NOISE_STARTS = ("A new session was started via", "Pre-compaction memory flush")
NOISE_PATTERNS = (r"^✅\s*New session started", r"^NO_REPLY\s*$")
NOISE_TEXT = "(session bootstrap)"
ONLY_SIGNS = r"^[^\w\s一-鿿぀-ヿ가-힯]{1,5}$"
ONLY_QUESTION = r"^[?？]+$"
INJECTION = (
    r"(?i)ignore\b.{0,30}\b(instructions|rules|guidelines)",
    r"(?i)disregard\b.{0,30}\b(instructions|rules|guidelines)",
    r"(?i)forget\b.{0,30}\b(instructions|rules|context)",
    r"(?i)override\b.{0,30}\b(instructions|rules|guidelines|safety)",
    r"(?i)you are now (?!going|about|ready)",
    r"(?i)act as (?:if you are |if you were )?(?:a |an )?(?:root|admin|unrestricted|unfiltered|jailbroken)",
    r"(?i)enter (?:DAN|jailbreak|god|sudo|developer|dev|debug|unrestricted|unfiltered) mode",
    r"(?i)switch to (?:DAN|jailbreak|god|sudo|developer|dev|debug|unrestricted|unfiltered) mode",
    r"(?i)(?:show|reveal|print|output|display|repeat|leak|dump|give)\b.{0,20}\bsystem prompt",
    r"(?i)reveal (?:your |the )?(system|hidden|secret|internal) (?:prompt|instructions|rules)",
    r"(?i)what (?:are|is) your (?:system|hidden|original|initial) (?:prompt|instructions|rules)",
    r"(?i)<\s*(system|assistant|developer|tool|function|relevant-memories)\b",
    r"(?i)\b(run|execute|call|invoke)\b.{0,40}\b(tool|command|function|shell)\b",
    r"忽略(?:所有|之前|以上|先前)?(?:的)?(?:指令|规则|指示|说明)",
    r"无视(?:所有|之前|以上)?(?:的)?(?:指令|规则|限制)",
    r"(?:显示|输出|告诉我|给我看)(?:你的)?(?:系统|初始|隐藏)?(?:提示词|指令|规则|prompt)",
    r"你(?:现在|从现在开始)是",
)
CONTEXT_TAGS = r"(?i)<(/?(?:user-persona|relevant-memories|scene-navigation|relevant-scenes|memory-tools-guide|system|assistant))>"
SKIPPED_KEYS = (":memory-scene-extract-", ":subagent:")
SKIPPED_KEY_START = "temp:"
SKIPPED_TRIGGERS = ("cron", "heartbeat", "automation", "schedule")
OVERFLOW = (
    "context_length", "context length", "prompt is too long", "max_tokens", "request too large", "compaction", "prompt_too_long", "string_above_max_length",
)
STOP_WORDS = (
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着",
    "没有", "看", "好", "自己", "这", "他", "她", "它", "们", "那", "吗", "吧", "呢", "啊", "呀", "哦", "嗯",
)
SCENE_SIGNS = r"[()\[\]{}<>'\"`,;:!?*|/\\=&%$#@^~+]"
TIME_LABEL, TIME_FROM, TIME_UNTIL = "活动时间: ", "起", "至"
CJK = r"[一-鿿぀-ヿ가-힯]"
FOLD_FROM, FOLD_TO = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


# How a text asks for a persona update.
PERSONA_BLOCK = r"(?s)\[PERSONA_UPDATE_REQUEST\]\s*(?:reason:\s*)?(.+?)\s*\[/PERSONA_UPDATE_REQUEST\]"
PERSONA_INLINE = r"PERSONA_UPDATE_REQUEST:\s*(.+?)(?:\n|$)"


def trim_all(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def _squeeze(c: Column) -> Column:
    return trim_all(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def sanitize(c: Column) -> Column:
    """Text without injected context, metadata, directives, media marks and binary data; null stays null."""
    for pattern in REMOVED:
        c = F.regexp_replace(c, pattern, "")
    return _squeeze(F.replace(c, F.lit("\x00"), F.lit("")))


def strip_code_blocks(c: Column) -> Column:
    return _squeeze(F.regexp_replace(c, CODE_BLOCK, ""))


def is_noise(c: Column) -> Column:
    t = trim_all(c)
    out = t == NOISE_TEXT
    for start in NOISE_STARTS:
        out = out | t.startswith(start)
    for pattern in NOISE_PATTERNS:
        out = out | t.rlike(pattern)
    return out


def should_capture(c: Column) -> Column:
    """The permissive gate: not blank, no framework noise, no slash command. Null: false."""
    return F.coalesce((trim_all(c) != "") & ~is_noise(c) & ~c.startswith("/"), F.lit(False))


def looks_like_injection(c: Column) -> Column:
    normal = trim_all(F.regexp_replace(c, f"{WHITE}+", " "))
    out = F.lit(False)
    for pattern in INJECTION:
        out = out | normal.rlike(pattern)
    return F.coalesce(out, F.lit(False))


def should_extract(c: Column) -> Column:
    """The strict gate: captured, not signs or question marks alone, no injection."""
    return should_capture(c) & ~c.rlike(ONLY_SIGNS) & ~c.rlike(ONLY_QUESTION) & ~looks_like_injection(c)


def glob_pattern(glob: str) -> str:
    """An unanchored pattern in which only * is special."""
    signs = set(".+^${}()|[]\\?")
    return "".join(".*" if x == "*" else f"\\{x}" if x in signs else x for x in glob)


def skip_session(key: Column, session_id: Column | None = None, trigger: Column | None = None, globs: tuple[str, ...] = ()) -> Column:
    """Whether a session is internal, temporary or not interactive; a missing key is skipped."""
    out = key.isNull() | (key == "") | key.startswith(SKIPPED_KEY_START) | key.rlike(r"(?i):(?:cron|heartbeat):")
    for part in SKIPPED_KEYS:
        out = out | key.contains(part)
    wanted = [glob_pattern(g.strip()) for g in globs if g.strip()]
    if wanted:
        out = out | key.rlike("|".join(wanted))
    if session_id is not None:
        out = out | F.coalesce(session_id.startswith("memory-"), F.lit(False))
    if trigger is not None:
        out = out | F.coalesce(F.lower(trigger).isin(*SKIPPED_TRIGGERS), F.lit(False))
    return F.coalesce(out, F.lit(True))


def is_internal_session(key: Column) -> Column:
    return key.rlike(r"memory-.*-session-\d+")


def fold(c: Column) -> Column:
    """Lower case without Latin diacritics."""
    return F.translate(F.lower(c), FOLD_FROM, FOLD_TO)


def terms(c: Column) -> Column:
    """Index terms in order, with repeats: runs of letters and digits, folded."""
    return F.regexp_extract_all(fold(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def query_terms(c: Column) -> Column:
    """Distinct terms of a query without stop words."""
    return F.array_except(F.array_distinct(terms(c)), F.array(*map(F.lit, STOP_WORDS)))


def word_set(c: Column) -> Column:
    """Latin words of two characters or more, CJK characters and their neighbouring pairs; distinct."""
    latin = F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]{2,})"), F.lit(1))
    cjk = F.regexp_extract_all(c, F.lit(f"({CJK})"), F.lit(1))
    pairs = F.when(F.size(cjk) > 1, F.zip_with(F.slice(cjk, 1, F.size(cjk) - 1), F.slice(cjk, 2, F.size(cjk) - 1), lambda a, b: F.concat(a, b)))
    return F.array_distinct(F.concat(latin, cjk, F.coalesce(pairs, F.array().cast("array<string>"))))


def persona_signal(c: Column) -> Column:
    """The reason of a persona update that a text asks for, from a block or else inline; null where there is none."""
    block = F.regexp_extract(c, PERSONA_BLOCK, 1)
    inline = F.regexp_extract(c, PERSONA_INLINE, 1)
    some = lambda x: F.when(x != "", trim_all(x))
    return F.coalesce(some(block), some(inline))


def escape_tags(c: Column) -> Column:
    return F.regexp_replace(c, CONTEXT_TAGS, "&lt;$1&gt;")


def truncate_line(c: Column, most: Column | int, suffix: str = "…") -> Column:
    """At most `most` characters, ending in the suffix where it was cut and there is room for it."""
    most = F.lit(most) if isinstance(most, int) else most
    n = len(suffix)
    cut = F.concat(F.regexp_replace(F.substring(c, F.lit(1), most - n), f"{WHITE}+$", ""), F.lit(suffix))
    return F.when(F.char_length(c) <= most, c).when(most <= n, F.substring(c, F.lit(1), most)).otherwise(cut)


def agent_id(key: Column) -> Column:
    """The agent of a key `agent:id:rest`; empty where it has another form."""
    parts = F.split(key, ":")
    return F.when((parts[0] == "agent") & (F.size(parts) >= 2), parts[1]).otherwise(F.lit(""))


def safe_path(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[<>:\"/\\|?*\x00-\x1f]", "_"), r"\.{2,}", "_")


def parse_session_key(key: Column) -> Column:
    """struct(agent, session) of `agent:name:session`, null for other forms; a worker's number goes to the agent."""
    parts = F.split(key, ":")
    session = F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), ":")
    worker = F.regexp_extract(session, r"swebench-w(\d+)", 1)
    agent = F.when(worker != "", F.concat(parts[1], F.lit("-w"), worker)).otherwise(parts[1])
    good = (F.size(parts) >= 3) & (parts[0] == "agent") & (parts[1] != "") & (session != "")
    return F.when(good, F.struct(safe_path(agent).alias("agent"), safe_path(session).alias("session")))


def heat_mark(heat: Column) -> Column:
    """0 to 5 by heat."""
    out = F.lit(0)
    for level, least in enumerate((50, 100, 200, 500, 1000), 1):
        out = F.when(heat >= least, level).otherwise(out)
    return out


def scene_file_name(name: Column) -> Column:
    """A plain `.md` name: last path part, blanks to hyphens, signs dropped, separators squeezed."""
    c = F.regexp_replace(F.coalesce(name, F.lit("")), r"^.*[\\/]", "")
    c = F.regexp_replace(c, r"(?i)\.md$", "")
    c = F.regexp_replace(c, r"[\s\u00A0\u3000]+", "-")
    c = F.regexp_replace(c, SCENE_SIGNS, "")
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "-{2,}", "-"), "_{2,}", "_"), r"\.{2,}", ".")
    c = F.regexp_replace(c, r"^[-_.]+|[-_.]+$", "")
    return F.concat(F.when(c == "", F.lit("scene")).otherwise(c), F.lit(".md"))


def profile_id(scope: Column, kind: Column, name: Column) -> Column:
    zero = F.lit("\x00")
    return F.concat(F.lit("profile:v1:"), F.sha2(F.concat(scope, zero, kind, zero, name), 256))


def utf16_length(c: Column) -> Column:
    """Units of UTF-16: characters beyond the basic plane count twice."""
    return F.char_length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def utf16_units(c: Column) -> Column:
    """The units of UTF-16 as numbers, a pair for each character beyond the basic plane."""
    code = F.transform(F.filter(F.split(c, ""), lambda ch: ch != ""), F.ascii)
    pair = lambda u: F.array(F.floor((u - 0x10000) / 1024).cast("int") + 0xD800, (u - 0x10000) % 1024 + 0xDC00)
    return F.flatten(F.transform(code, lambda u: F.when(u < 0x10000, F.array(u)).otherwise(pair(u))))


def quick_tokens(c: Column) -> Column:
    """ceil(1.5 x CJK characters + the other units of UTF-16 / 4)."""
    cjk = F.regexp_count(c, F.lit(CJK))
    return F.ceil(cjk * 1.5 + (utf16_length(c) - cjk) / 4).cast("long")


def tool_key(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(""))


def fingerprint(role: Column, content: Column) -> Column:
    """A signed 32-bit hash (from 5381, times 33 plus the unit) of the role and the first 200 units of UTF-16."""
    units = F.concat(utf16_units(F.concat(role, F.lit(":"))), F.slice(utf16_units(F.substring(content, 1, 200)), 1, 200))
    wrap = lambda v: F.pmod(v + (1 << 31), F.lit(1 << 32)) - (1 << 31)
    return F.aggregate(units, F.lit(5381).cast("long"), lambda h, u: wrap(h * 33 + u))


def canvas_nodes(c: Column) -> Column:
    """Node ids like 001-N2 in a canvas, distinct, in order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b(\d{3}-N\d+)\b"), F.lit(1)))


def is_overflow_error(c: Column) -> Column:
    """Whether an error message says that a prompt was too long."""
    low = F.lower(F.coalesce(c, F.lit("")))
    about_tokens = F.lit(False)
    for part in ("exceed", "limit", "overflow", "too long"):
        about_tokens = about_tokens | low.contains(part)
    out = low.contains("token") & about_tokens
    for part in OVERFLOW:
        out = out | low.contains(part)
    return out


def memory_line(kind: Column, scene: Column, content: Column, start: Column, end: Column, point: Column) -> Column:
    """`- [kind|scene] content` with the time of the activity: a range, an open one, or a point. Times are written already; empty: none."""
    tag = F.when(F.coalesce(scene, F.lit("")) != "", F.concat(kind, F.lit("|"), scene)).otherwise(kind)
    s, e, p = (F.coalesce(x, F.lit("")) for x in (start, end, point))
    time = (
        F.when((s != "") & (e != ""), F.concat(s, F.lit(" ~ "), e))
        .when(s != "", F.concat(s, F.lit(TIME_FROM)))
        .when(e != "", F.concat(F.lit(TIME_UNTIL), e))
        .otherwise(p)
    )
    return F.concat(F.lit("- ["), tag, F.lit("] "), content, F.when(time != "", F.concat(F.lit(f" ({TIME_LABEL}"), time, F.lit(")"))).otherwise(F.lit("")))


def parse_memory_line(line: Column) -> Column:
    """struct(kind, content) of a memory line; `unknown` and the line itself where it is none."""
    pattern = rf"^-\s+\[([^\]]+)\]\s+(.+?)(?:\s*\({TIME_LABEL[:-1]}.*\))?$"
    tag = F.regexp_extract(line, pattern, 1)
    good = line.rlike(pattern)
    return F.struct(
        F.when(good, F.split(tag, "[|]")[0]).otherwise(F.lit("unknown")).alias("kind"),
        F.when(good, trim_all(F.regexp_extract(line, pattern, 2))).otherwise(line).alias("content"),
    )
