"""What an input is: a web address of a known site, a file of a known type, a phrase to search for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of hosts and what they are, in order. ----------------------------------------------------------
PASTE_HOSTS = ["douyin.com", "xiaohongshu.com", "kuaishou.com", "instagram.com"]
REMOVED_HOSTS = ["youtube.com", "youtu.be", "x.com", "twitter.com", "medium.com"]
#: (part of a host, name of the site, what an address of it is; None: any web page)
SITES = [
    ("mp.weixin.qq.com", "微信公众号", "weixin"), ("xiaoyuzhoufm.com", "小宇宙播客", "podcast"), ("ximalaya.com", "喜马拉雅", "podcast"), ("bilibili.com", "B站视频", "video"),
    ("weibo.com", "微博", "weibo"), ("toutiao.com", "今日头条", "news"), ("baijiahao.baidu.com", "百家号", "news"), ("weread.qq.com", "微信读书", None), ("zhihu.com", "知乎", None),
    ("juejin.cn", "掘金", None), ("csdn.net", "CSDN", None), ("jianshu.com", "简书", None), ("sspai.com", "少数派", None), ("36kr.com", "36氪", None), ("infoq.cn", "InfoQ", None),
    ("water.gov.cn", "水利部", None), ("mwr.gov.cn", "水利部", None), ("mee.gov.cn", "生态环境部", None), ("ihchina.cn", "中国古迹遗址保护协会", None), ("hikvision.com", "海康威视", None),
    ("dahuatech.com", "大华技术", None), ("huaweicloud.com", "华为云", None), (".gov.cn", "政务网站", None),
]
INTENTS = {
    "audio": "podcast", "播客": "podcast", "音频": "podcast", "语音": "podcast", "slide-deck": "pptx", "ppt": "pptx", "幻灯片": "pptx", "演示": "pptx", "slide_deck": "pptx",
    "mind-map": "mindmap", "思维导图": "mindmap", "脑图": "mindmap", "quiz": "quiz", "出题": "quiz", "测验": "quiz", "试题": "quiz", "report": "report", "报告": "report",
    "总结": "report", "文档": "report", "flashcards": "flashcards", "闪卡": "flashcards", "记忆卡片": "flashcards", "data-table": "table", "表格": "table", "数据表": "table",
}
AUDIO = [".mp3", ".wav", ".m4a", ".flac", ".mp4", ".mkv", ".mov", ".aac"]
# --------------------------------------------------------------------------------------------------------------------


def input_type(col, supported: list[str]) -> Column:
    """paste, removed, the kind of a site, url, epub, audio, zip, document, search or unknown."""
    s = F.trim(F.col(col) if isinstance(col, str) else col)
    host = F.lower(F.regexp_extract(s, r"^https?://(?:[^/@]*@)?([^/:?#]+)", 1))
    ext = F.lower(F.regexp_extract(s, r"(\.[A-Za-z0-9]+)$", 1))
    site = F.coalesce(*[F.when(F.contains(host, F.lit(h)), "paste") for h in PASTE_HOSTS], *[F.when(F.contains(host, F.lit(h)), "removed") for h in REMOVED_HOSTS], *[F.when(F.contains(host, F.lit(h)), kind) for h, _, kind in SITES if kind], F.lit("url"))
    kind = F.when(ext == ".epub", "epub").when(ext.isin(AUDIO), "audio").when(ext == ".zip", "zip").when(ext.isin(supported), "document")
    phrase = F.rlike(s, F.lit(r"(?U)^[\w一-鿿\- ]{2,60}$"))
    return F.when(host != "", site).otherwise(F.coalesce(kind, F.when(phrase, "search"), F.lit("unknown")))


def site_name(url) -> Column:
    """The name of the first known site that the address's host contains, else that of any web page."""
    host = F.lower(F.regexp_extract(F.col(url) if isinstance(url, str) else url, r"^https?://(?:[^/@]*@)?([^/:?#]+)", 1))
    return F.coalesce(*[F.when(F.contains(host, F.lit(h)), name) for h, name, _ in SITES], F.lit("网页"))


def intent(col) -> Column:
    """The product that a name or a request asks for; null where none is named."""
    t = F.lower(F.col(col) if isinstance(col, str) else col)
    return F.coalesce(*[F.when(F.contains(t, F.lit(k)), v) for k, v in INTENTS.items()])


def need(topic, audience, scene, industry, pages) -> dict[str, Column]:
    """Whether a request for a deck says enough: missing (how many of topic, audience, scene, pages and industry), level
    (vague, partial, ok), pages (asked for within 3 and 40, or suggested by scene)."""
    given = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    n = F.coalesce(F.col(pages), F.lit(0))
    vague = F.char_length(F.trim(F.coalesce(F.col(topic), F.lit("")))) < 6
    missing = sum(((~given(c)).cast("int") for c in (audience, scene, industry)), vague.cast("int") + (n == 0).cast("int"))
    level = F.when(vague | (missing >= 3), "vague").when(missing == 0, "ok").otherwise("partial")
    suggested = F.when(n > 0, F.least(F.greatest(n, F.lit(3)), F.lit(40))).when(F.col(scene).isin("培训授课", "产品发布", "立项汇报"), 12).otherwise(8)
    return {"missing": missing, "level": level, "pages": suggested}
