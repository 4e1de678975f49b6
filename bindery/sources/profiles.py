"""Site profiles: selectors and crawl strategy per kind of site.

Profiles are configuration, a handful of rows; they are kept on the driver to
build expressions and are also available as a table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Image options, selector lists, site patterns and strategies.
IMAGE_OPTIONS = {"max_width": 1200, "max_height": 1600, "quality": 70, "format": "jpeg", "download_timeout": 10000}

DEFAULT_CONTENT = [
    "article", "main", '[role="main"]', ".content", ".post-content", ".article-content", ".entry-content",
    ".markdown-body", "#content", ".page-content",
]
DEFAULT_TITLE = ["h1", "article h1", ".title", ".post-title", ".entry-title", "header h1", ".page-title"]
DEFAULT_NAVIGATION = [
    "nav a", ".sidebar a", ".sidebar-nav a", ".toc a", ".table-of-contents a", "#sidebar a", ".book-summary a", ".menu a",
]
DEFAULT_EXCLUDE = [
    "script", "style", "noscript", "iframe", "nav", "header", "footer", ".navigation", ".nav", ".sidebar", ".toc",
    ".table-of-contents", ".comments", ".comment", ".advertisement", ".ad", ".ads", ".social-share",
    ".share-buttons", ".related-posts", ".breadcrumb", ".breadcrumbs", '[role="navigation"]', '[role="banner"]',
    '[role="contentinfo"]', ".edit-link", ".edit-page", ".page-nav", ".pagination",
]

SIDEBAR_SELECTOR = (
    ".sidebar a, .sidebar-nav a, #sidebar a, nav a, .chapter a, .chapter-link a, "
    '[class*="sidebar"] a, [class*="chapter"] a, [role="navigation"] a, .book-summary a, .summary a'
)
DOCS_SIDEBAR = '.sidebar a, .sidebar-nav a, .chapter a, .chapter-link a, [class*="chapter"] a, nav a'
NEXT_SELECTORS = [
    'a[rel="next"]', ".next a", "a.next", ".pagination-next a", 'a:contains("Next")', 'a:contains("→")',
    'a:contains("»")', ".nav-next a", '[aria-label="Next"]',
]


@dataclass(frozen=True)
class Profile:
    """One kind of site: how to recognise it, what to select, how to crawl it."""

    name: str
    url_patterns: list[str] = field(default_factory=list)
    html_patterns: list[str] = field(default_factory=list)
    content: list[str] = field(default_factory=lambda: DEFAULT_CONTENT)
    title: list[str] = field(default_factory=lambda: DEFAULT_TITLE)
    navigation: list[str] = field(default_factory=lambda: DEFAULT_NAVIGATION)
    exclude: list[str] = field(default_factory=lambda: DEFAULT_EXCLUDE)
    strategy: str = "auto"
    selector: str | None = None
    next_selector: str | None = None
    prev_selector: str | None = None
    chapter_link: str | None = None
    image_options: dict | None = None


DEFAULT = Profile("default")

# fixed values: profiles of known documentation sites
DOCS_CONTENT = [".markdown-body", "article.markdown-body", "#main", "main", ".content", "section.content", "article"]
DOCS_TITLE = ["h1", ".markdown-body h1", "article h1", "#main h1"]
DOCS_NAVIGATION = [
    ".sidebar-nav a", ".sidebar a", "nav.sidebar a", "#sidebar a", ".book-summary a", ".summary a", "aside a",
]
DOCS_EXCLUDE = [
    *DEFAULT_EXCLUDE, ".docsify-copy-code-button", ".anchor", ".edit-link", ".gitbook-link", ".github-corner",
    ".progress", ".search", "#search",
]
DOCS_CHAPTER_LINK = 'a[href$=".md"], a[href$=".html"], a[href^="#/"]'

# in order of priority
PROFILES = [
    Profile(
        name="docsify",
        url_patterns=[r"github\.io", "docsify"],
        html_patterns=["window.$docsify", "docsify.min.js", "docsify.js", "data-docsify"],
        content=DOCS_CONTENT,
        title=DOCS_TITLE,
        navigation=DOCS_NAVIGATION,
        exclude=DOCS_EXCLUDE,
        strategy="sidebar",
        selector=DOCS_SIDEBAR,
        chapter_link=DOCS_CHAPTER_LINK,
    ),
    Profile(
        name="gitbook",
        url_patterns=["gitbook"],
        html_patterns=["gitbook.js", "gitbook.min.js", "book-summary", "GitBook"],
        content=[
            ".page-inner section.normal", ".page-inner", ".book-body .body-inner", ".markdown-section",
            "section.markdown-section",
        ],
        title=["h1", ".page-inner h1", "section h1"],
        navigation=[".book-summary a", ".summary a", "nav.summary a", ".chapter a"],
        exclude=[
            *DEFAULT_EXCLUDE, ".book-header", ".book-summary", ".navigation", ".page-footer", ".gitbook-link",
        ],
        strategy="sidebar",
        selector='.book-summary a, .summary a, .chapter a, [class*="chapter"] a',
        chapter_link="a.chapter-link, .chapter a",
    ),
    Profile(
        name="jekyll",
        url_patterns=["jekyll", r"\.github\.io"],
        html_patterns=["jekyll", "site.baseurl", "_site"],
        content=[".post-content", ".page-content", "article", ".content", "main"],
        title=[".post-title", ".page-title", "h1.title", "article h1", "h1"],
        navigation=[".site-nav a", "nav a", ".nav-list a", ".toc a"],
        exclude=[*DEFAULT_EXCLUDE, ".site-header", ".site-footer", ".post-meta", ".post-nav"],
    ),
    Profile(
        name="github-pages",
        url_patterns=[r"github\.io", "githubusercontent"],
        content=DOCS_CONTENT,
        title=DOCS_TITLE,
        navigation=DOCS_NAVIGATION,
        exclude=DOCS_EXCLUDE,
        strategy="sidebar",
        selector=DOCS_SIDEBAR,
        chapter_link=DOCS_CHAPTER_LINK,
    ),
]

# Selector presets for parsing without site detection.
PRESETS = {
    "default": Profile(
        name="default",
        content=[*DEFAULT_CONTENT, ".post", ".entry"],
        title=["h1", "article h1", "main h1", ".title", ".post-title", ".entry-title", ".page-title", "header h1"],
        navigation=[*DEFAULT_NAVIGATION, ".nav-menu a"],
        exclude=[
            "script", "style", "noscript", "iframe", "nav", "header", "footer", ".navigation", ".nav", ".sidebar",
            ".toc", ".table-of-contents", ".comments", ".advertisement", ".ad", ".social-share", ".share-buttons",
            ".related-posts", ".breadcrumb", ".pagination", ".edit-link",
        ],
    ),
    "docsify": Profile(
        name="docsify",
        content=[".markdown-body", "article.markdown-body", "#main", "main", ".content", "section.content"],
        title=DOCS_TITLE,
        navigation=[".sidebar-nav a", ".sidebar a", "nav.sidebar a", "#sidebar a"],
        exclude=[
            "script", "style", "noscript", ".docsify-copy-code-button", ".anchor", ".edit-link", ".github-corner",
            ".progress", ".search", "#search", ".sidebar", ".sidebar-nav", "nav", "footer",
        ],
        chapter_link=DOCS_CHAPTER_LINK,
    ),
    "gitbook": Profile(
        name="gitbook",
        content=PROFILES[1].content,
        title=PROFILES[1].title,
        navigation=PROFILES[1].navigation,
        exclude=[
            "script", "style", "noscript", ".book-header", ".book-summary", ".navigation", ".page-footer",
            ".gitbook-link", ".search-wrapper", ".search-results",
        ],
        chapter_link="a.chapter-link, .chapter a",
    ),
    "jekyll": Profile(
        name="jekyll",
        content=PROFILES[2].content,
        title=PROFILES[2].title,
        navigation=PROFILES[2].navigation,
        exclude=[
            "script", "style", "noscript", ".site-header", ".site-footer", ".site-nav", ".post-meta", ".post-nav",
            ".social-media-list", ".pagination",
        ],
    ),
    "github": Profile(
        name="github",
        content=[".markdown-body", "article.markdown-body", "#readme", ".entry-content"],
        title=["h1", ".markdown-body h1", "#readme h1"],
        navigation=[".toc a", '.markdown-body a[href^="#"]'],
        exclude=["script", "style", "noscript", ".anchor", ".octicon", ".task-list-item-checkbox"],
    ),
}

_LIST = "array<string>"
PROFILE_SCHEMA = (
    f"priority int, name string, url_patterns {_LIST}, html_patterns {_LIST}, content {_LIST}, title {_LIST}, "
    f"navigation {_LIST}, exclude {_LIST}, chapter_link string, "
    "strategy struct<type:string,selector:string,next_selector:string,prev_selector:string>, "
    "image_options struct<max_width:int,max_height:int,quality:int,format:string,download_timeout:int>"
)
CONFIG_SCHEMA = (
    f"selectors struct<content:{_LIST},title:{_LIST},navigation:{_LIST},exclude:{_LIST},chapterLink:string>, "
    "crawlStrategy struct<type:string,selector:string,nextSelector:string,prevSelector:string>, "
    "imageOptions struct<maxWidth:int,maxHeight:int,quality:int,format:string,downloadTimeout:int>"
)


def site_profiles(spark: SparkSession, profiles: list[Profile] | None = None) -> DataFrame:
    """The profile dimension table: detection order, then the default."""
    rows = [
        (i, p.name, p.url_patterns, p.html_patterns, p.content, p.title, p.navigation, p.exclude, p.chapter_link,
         (p.strategy, p.selector, p.next_selector, p.prev_selector), tuple(IMAGE_OPTIONS.values()))
        for i, p in enumerate([*(PROFILES if profiles is None else profiles), DEFAULT])
    ]
    return spark.createDataFrame(rows, PROFILE_SCHEMA)


def load_profiles(spark: SparkSession, path: str) -> DataFrame:
    """User configuration: one JSON object per file, every key optional."""
    return spark.read.schema(CONFIG_SCHEMA).json(path, multiLine=True, mode="FAILFAST")


def merge_profile(partial: DataFrame) -> DataFrame:
    """Fill a partial configuration from the defaults.

    Selector lists and image options merge key by key; a given strategy replaces
    the default as a whole.
    """
    lists = {"content": DEFAULT.content, "title": DEFAULT.title, "navigation": DEFAULT.navigation, "exclude": DEFAULT.exclude}
    filled = [F.coalesce(F.col(f"selectors.{k}"), F.array(*map(F.lit, v))).alias(k) for k, v in lists.items()]
    wire = ("maxWidth", "maxHeight", "quality", "format", "downloadTimeout")
    options = [
        F.coalesce(F.col(f"imageOptions.{w}"), F.lit(v)).alias(k) for w, (k, v) in zip(wire, IMAGE_OPTIONS.items())
    ]
    given = F.struct(
        F.col("crawlStrategy.type").alias("type"),
        F.col("crawlStrategy.selector").alias("selector"),
        F.col("crawlStrategy.nextSelector").alias("next_selector"),
        F.col("crawlStrategy.prevSelector").alias("prev_selector"),
    )
    none = F.lit(None).cast("string")
    auto = F.struct(F.lit("auto").alias("type"), none.alias("selector"), none.alias("next_selector"), none.alias("prev_selector"))
    return partial.select(
        *filled,
        F.col("selectors.chapterLink").alias("chapter_link"),
        F.when(F.col("crawlStrategy").isNotNull(), given).otherwise(auto).alias("strategy"),
        F.struct(*options).alias("image_options"),
    )


def as_profile(merged: DataFrame, name: str = "user") -> Profile:
    """One merged configuration row as a driver-side profile which fits every site.

    Raises INVALID_CONFIG for a selector which is not understood.
    """
    from bindery.operators.selectors import parse_selector

    row = merged.first()
    s = row.strategy
    single = [x for x in (s.selector, s.next_selector, s.prev_selector, row.chapter_link) if x]
    for selector in [*row.content, *row.title, *row.navigation, *row.exclude, *single]:
        if parse_selector(selector) is None:
            raise ValueError(f"[INVALID_CONFIG] selector not understood: {selector}")
    return Profile(
        name=name,
        url_patterns=[""],
        content=row.content,
        title=row.title,
        navigation=row.navigation,
        exclude=row.exclude,
        strategy=s.type,
        selector=s.selector,
        next_selector=s.next_selector,
        prev_selector=s.prev_selector,
        chapter_link=row.chapter_link,
        image_options=row.image_options.asDict(),
    )
