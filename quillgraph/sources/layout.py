"""Layout JSON of papers: DIRECTORY/PAPER/parsing_paddle.json."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import has_text, language
from ..schema import LAYOUT
from .datasource import register

FILE = "parsing_paddle.json"
SAMPLE_PAGES = 4


def layouts(spark: SparkSession, root: str, papers: list[str] | None = None) -> DataFrame:
    """One row per paper with its parsed file; a missing paper has none."""
    paths = [f"{root}/*/{FILE}"] if papers is None else [f"{root}/{p}/{FILE}" for p in papers]
    read = spark.read.schema(LAYOUT).option("multiLine", True).option("ignoreMissingFiles", True).json(paths)
    return read.withColumn("paper_id", F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+)/{FILE}$", 1))


def from_source(rows: DataFrame) -> DataFrame:
    """Rows of the data source (paper_id, value), batch or stream, as `layouts` gives them."""
    return rows.select(F.from_json("value", LAYOUT).alias("layout"), "paper_id").select("layout.*", "paper_id")


def source(spark: SparkSession, root: str, **options) -> DataFrame:
    """The layouts of a folder by the data source."""
    register(spark)
    return from_source(spark.read.format("paper_layouts").options(**options).load(root))


def source_stream(spark: SparkSession, root: str, listing: str, **options) -> DataFrame:
    """The layouts of a folder as a stream, which keeps its listing in a folder of its own."""
    register(spark)
    return from_source(spark.readStream.format("paper_layouts").options(listing=listing, **options).load(root))


def list_papers(spark: SparkSession, root: str) -> DataFrame:
    register(spark)
    return spark.read.format("paper_layouts").option("names", "true").load(root).select("paper_id").distinct().orderBy("paper_id")


def elements(layout: DataFrame) -> DataFrame:
    """Elements in order: page, then titles, authors, texts, visuals and tables.

    Empty titles, authors and texts are left out; confidence is 1 by default, and the page number -1.
    """
    pages = layout.select("paper_id", F.posexplode("pages").alias("page_pos", "p"))
    nothing, empty = F.lit(None).cast("string"), F.lit("")

    def of(field: str, rank: int, kind: str, content: Callable, caption: Callable = lambda e: nothing, image: Callable = lambda e: nothing) -> Column:
        row = lambda e, i: F.struct(
            F.lit(rank).alias("kind_rank"), i.alias("elem_pos"), F.lit(kind).alias("element_type"), content(e).alias("content"),
            image(e).alias("image_path"), F.coalesce(e["confidence"], F.lit(1.0)).alias("confidence"), caption(e).alias("caption"),
        )
        return F.coalesce(F.transform(f"p.{field}", row), F.array())

    caption, image = lambda e: e["caption"], lambda e: F.nullif(e["image_path"], empty)
    spoken = [of(f"{k}_elements", i, k, lambda e: F.coalesce(e["text"], empty)) for i, k in enumerate(("title", "author", "text"))]
    visual = of("visual_elements", 3, "figure", lambda e: F.coalesce(e["caption"], empty), caption, image)
    table = of("table_elements", 4, "table", lambda e: F.coalesce(F.nullif(e["text"], empty), e["caption"], empty), caption, image)
    # all kinds at once: a layout is read and parsed a single time
    rows = pages.select("paper_id", F.coalesce("p.page_number", F.lit(-1)).alias("page"), "page_pos", F.explode(F.concat(*spoken, visual, table)).alias("e"))
    out = rows.select("paper_id", "page", "page_pos", *[f"e.{c}" for c in ("kind_rank", "elem_pos", "element_type", "content", "image_path", "confidence", "caption")])
    return out.where((F.col("kind_rank") > 2) | has_text(F.col("content")))


#: Parsers by name: a function of a session and a folder that gives elements.  Others may be added.
PARSERS = {"layout": lambda spark, root: elements(layouts(spark, root)), "source": lambda spark, root: elements(source(spark, root))}


def parsed(spark: SparkSession, root: str, parser: str = "layout") -> DataFrame:
    if parser not in PARSERS:
        raise ValueError(f"unknown parser {parser!r}; known are {sorted(PARSERS)}")
    return PARSERS[parser](spark, root)


def with_images(rows: DataFrame, spark: SparkSession, root: str) -> DataFrame:
    """image_path resolved against the files there are: PAPER/path, else PAPER/images/name, else null."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    top = top.makeQualified(top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri(), top).toString()  # as paths of files begin
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.expr(f"substring(path, {len(top) + 2})").alias("file"))
    first = F.concat_ws("/", "paper_id", "image_path")
    second = F.concat_ws("/", F.col("paper_id"), F.lit("images"), F.regexp_extract("image_path", r"([^/]+)$", 1))
    a, b = files.select(F.col("file").alias("file_a")), files.select(F.col("file").alias("file_b"))
    keyed = rows.withColumn("a", F.when(F.col("image_path").isNotNull(), first)).withColumn("b", F.when(F.col("image_path").isNotNull(), second))
    found = keyed.join(a, keyed["a"] == a["file_a"], "left").join(b, keyed["b"] == b["file_b"], "left")
    return found.withColumn("image_path", F.coalesce("file_a", "file_b")).drop("a", "b", "file_a", "file_b")


def paper_languages(layout: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """paper_id and language, from the texts of the first pages; papers of `known` are not looked at again."""
    new = layout if known is None else layout.join(known.select("paper_id"), "paper_id", "left_anti")
    texts = F.flatten(F.transform(F.slice("pages", 1, SAMPLE_PAGES), lambda p: F.transform(F.coalesce(p["text_elements"], F.array().cast("array<struct<text:string,confidence:double>>")), lambda e: F.coalesce(e["text"], F.lit("")))))
    out = new.select("paper_id", language(F.array_join(texts, " ")).alias("language"))
    return out if known is None else known.select("paper_id", "language").unionByName(out)


# How files of common image formats begin, and end where they have an end mark.
IMAGE_MARKS = ((b"\x89PNG\r\n\x1a\n", b"IEND\xaeB`\x82"), (b"\xff\xd8\xff", b"\xff\xd9"), (b"GIF8", b";"), (b"BM", b""), (b"RIFF", b""))


def decodes(content: bytes) -> bool:
    """Whether an image library can read the image; without one, whether it begins and ends as a common format does."""
    try:
        from PIL import Image
    except ImportError:
        return any(content.startswith(a) and content.rstrip(b"\0\r\n").endswith(b) for a, b in IMAGE_MARKS)
    import io

    try:
        Image.open(io.BytesIO(content)).verify()
    except Exception:  # any failure means that a model cannot read it either
        return False
    return True


def usable_images(spark: SparkSession, paths: list[str], least: int = 100) -> DataFrame:
    """The image files of at least `least` bytes that can be decoded."""

    def run(batches):
        for rows in batches:
            yield rows[[decodes(x) for x in rows["content"]]][["path", "length"]]

    files = spark.read.format("binaryFile").load(paths).where(F.col("length") >= least)
    return files.select("path", "length", "content").mapInPandas(run, "path string, length bigint")
