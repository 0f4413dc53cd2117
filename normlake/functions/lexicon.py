"""What a statement says about its own enforcement: checks, triggers and search hints, as Columns over given patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_markup

# Words that make a sentence a norm, and how strong they are (Chinese and English, case is ignored).
NORMATIVE = (
    r"(?:严禁|禁止|不得|不可(?!变)|不允许|不能|必须|务必|应当|应该|不应当|不应该|需要|需(?!求)(?:要)?|须(?!知)|只允许|只能|仅限|统一(?:使用|采用|放置|配置|通过)|"
    r"建议|推荐|宜|不宜|尽量|避免|请勿|确保|must\s+not|must|shall\s+not|shall|should\s+not|should|may\s+not|required|prohibited|recommended)"
)
STRONG = r"(?:严禁|禁止|不得|不可(?!变)|不允许|不能|只允许|只能|仅限|must\s+not|shall\s+not|prohibited)"
REQUIRED = r"(?:必须|务必|应当|需要|须|确保|must|shall|required)"
ADVISORY = r"(?:建议|推荐|宜|不宜|尽量|避免|should|recommended)"
# Terms of each category, in order of precedence.
CATEGORIES = {
    "security": ("安全", "漏洞", "注入", "鉴权", "权限", "认证", "密码", "口令", "加密", "解密", "敏感", "脱敏", "csrf", "xss", "反序列化", "sql injection", "路径穿越"),
    "performance": ("高性能", "性能", "并发", "线程", "线程池", "缓存", "内存", "吞吐", "延迟", "批量", "n+1", "复杂度", "锁", "连接池"),
    "project": ("项目规范", "项目结构", "模块", "目录", "路径", "包路径", "工程结构", "文件位置", "配套文件", "同步修改", "pom.xml"),
    "testing": ("测试", "单元测试", "集成测试", "mock", "覆盖率"),
    "logging": ("日志", "logger", "log.", "slf4j", "traceid", "链路"),
    "exception": ("异常", "exception", "throw", "catch", "错误码"),
    "database": ("数据库", "sql", "mybatis", "mapper", "事务", "索引", "查询"),
    "api": ("接口", "controller", "request", "response", "spring mvc", "参数校验"),
}
# Signs of code, of paths, and of changes that belong together.
NAME = r"[A-Za-z_$][\w$]*"
CODE = rf"`[^`]+`|@[A-Z][A-Za-z0-9_]*|\b{NAME}(?:\.{NAME})+\b|\b(?:new|catch|throw|return)\s+{NAME}"
PATH = r"(?:路径|目录|模块|包(?:路径)?|package|module|src/main|[/\\]|\*\*/)"
TOGETHER = r"(?:同时|同步|一并|配套|对应).{0,16}(?:新增|创建|修改|更新|删除|提供)|(?:新增|创建|修改|更新|删除).{0,16}(?:同时|同步|一并|配套|对应)"
STATIC = r"(?:禁止|不得|必须).{0,24}(?:调用|使用|捕获|继承|实现|注解|日志)"
# Levels that make a structured rule advisory whatever its words.
ADVISORY_LEVELS = ("建议", "推荐", "参考", "advisory")
# Needles (spaces and case apart) and the search words that each group of them adds.
HINTS = (
    (("小驼峰", "驼峰命名"), ("camelCase", "变量命名", "字段命名", "局部变量")),
    (("javadoc", "顶层public类"), ("public class", "public interface", "public enum", "public record", "类注释")),
    (("反序列化",), ("ObjectInputStream", "readObject", "ObjectMapper.readValue", "JSON.parseObject", "外部数据")),
    (("格式化字符串", "string.format"), ("String.format", "Formatter", "format", "占位符", "外部输入", "请求参数")),
    (("外部数据", "外部输入", "用户输入"), ("request.getParameter", "不可信数据", "请求参数", "用户可控")),
)
DIRECT = (
    (("顶层public类", "publicclass"), ("public class", "public interface", "public enum", "public record")),
    (("反序列化",), ("ObjectInputStream", "readObject", "ObjectMapper.readValue", "JSON.parseObject")),
    (("格式化字符串", "string.format"), ("String.format", "Formatter")),
)


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?iU){pattern}")


def enforcement(statement: Column, code: str = CODE, path: str = PATH, together: str = TOGETHER, static: str = STATIC) -> Column:
    """How a statement may be enforced: reading in context always, then what its words suggest, a reviewer last."""
    checks = F.array(F.lit("coding_context"), F.when(_has(statement, together), "change_set_check"), F.when(_has(statement, path), "path_check"), F.when(_has(statement, code) | _has(statement, static), "static_check"), F.lit("ai_review"))
    return F.array_compact(checks)


def trigger_terms(raw: Column) -> Column:
    """Inline code, annotations, dotted names, file names and calls, each once, of 2 to 100 characters."""
    source = F.regexp_replace(raw, r"(?m)^\s*(?:```+|~~~+)[^\n]*$", "")
    # Inline code; annotations, dotted names and file names; calls.
    patterns = (r"(?<!`)`([^`\n]{1,100})`(?!`)", rf"(?U)(@[A-Z][A-Za-z0-9_]*|\b{NAME}(?:\.{NAME})+\b|\b{NAME}(?:\.java|\.xml|\.yml|\.yaml|\.properties)\b)", rf"(?U)(\b{NAME}(?:\.{NAME})+)\s*\(")
    found = F.concat(*[F.regexp_extract_all(source, F.lit(p), 1) for p in patterns])
    plain = F.transform(found, lambda t: F.when(t.rlike(r"[<\[`*_~>|\s；]"), strip_markup(t)).otherwise(t))
    return F.array_distinct(F.filter(plain, lambda t: (F.length(t) > 1) & (F.length(t) <= 100)))


def _added(text: Column, groups: tuple) -> Column:
    plain = F.replace(F.lower(text), F.lit(" "), F.lit(""))
    none = F.array().cast("array<string>")
    parts = []
    for needles, words in groups:
        hit = F.lit(False)
        for needle in needles:
            hit = hit | F.contains(plain, F.lit(needle))
        parts.append(F.when(hit, F.array(*map(F.lit, words))).otherwise(none))
    return F.array_distinct(F.concat(*parts))


def retrieval_hints(text: Column, groups: tuple = HINTS) -> Column:
    """Search words that a text's intents add."""
    return _added(text, groups)


def direct_triggers(text: Column, groups: tuple = DIRECT) -> Column:
    """Only those code signals that are precise enough to apply a rule at once; class comments count beside Javadoc only."""
    low = F.replace(F.lower(text), F.lit(" "), F.lit(""))
    first, *rest = groups
    return F.array_distinct(F.concat(F.when(F.contains(low, F.lit("javadoc")), _added(text, (first,))).otherwise(F.array().cast("array<string>")), _added(text, tuple(rest))))


def source_label(document: Column, section: Column) -> Column:
    """``document / section``, without the parts that are empty."""
    return F.concat_ws(" / ", F.nullif(document, F.lit("")), F.nullif(section, F.lit("")))
