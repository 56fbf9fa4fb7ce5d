"""Images of a question: inputs, asset files, observations and texts about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T

#: File endings of image assets, the preferred first.
ENDINGS = [".png", ".jpg", ".jpeg", ".webp", ".gif"]
#: Fields of an observation and the labels they get in a context.
CONTEXT_FIELDS = [
    ("ocr_text", "ocr"),
    ("vlm_summary", "visual_summary"),
    ("product_type", "product_type"),
    ("brand_or_model", "brand_or_model"),
    ("visible_error_code", "visible_error_code"),
    ("likely_intent", "likely_intent"),
    ("suggested_query", "suggested_query"),
]
_DATA_URL = r"(?i)^data:(image/[^;]+);base64,"
_BASE64 = r"^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z"


def base64(content: Column) -> Column:
    """In one line, whatever the session's setting for chunks."""
    return F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))


def data_url(mime: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), base64(content))


def decoded(value: Column) -> Column:
    """struct(mime, content, size_bytes) of a data URL or plain base64; null where
    the payload is no valid base64.  Without a data URL the type is image/png."""
    value = F.trim(value)
    mime = F.coalesce(F.nullif(F.lower(F.regexp_extract(value, _DATA_URL, 1)), F.lit("")), F.lit("image/png"))
    payload = F.regexp_replace(value, _DATA_URL, "")
    content = F.try_to_binary(payload, F.lit("base64"))
    return F.when(payload.rlike(_BASE64), F.struct(mime.alias("mime"), content.alias("content"), F.length(content).alias("size_bytes")))


def find_assets(wanted: DataFrame, files: DataFrame, folders: list[str], endings: list[str] = ENDINGS) -> DataFrame:
    """``image_id, path``: per id the file of the first folder, then of the first
    ending, that is there.  Ids without a file are left out; of an id that names
    folders only its last part counts."""
    rank = lambda listed, x: F.array_position(F.array(*map(F.lit, listed)), x)
    f = files.select("path", rank(folders, F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))
    ending = F.regexp_extract("name", r"(\.[^.]*)$", 1)
    f = f.withColumn("ending", rank(endings, ending)).withColumn("stem", F.expr("substr(name, 1, length(name) - length(regexp_extract(name, '(\\\\.[^.]*)$', 1)))"))
    best = f.where("folder > 0 and ending > 0 and stem <> ''").groupBy("stem").agg(F.min_by("path", F.struct("folder", "ending")).alias("path"))
    ids = wanted.select("image_id", F.regexp_extract("image_id", r"([^/]*)$", 1).alias("stem"))
    return ids.join(best, "stem").select("image_id", "path")


def with_observations(images: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """``images(key, index, ...)`` with ``summary`` of ``seen(key, pos, index,
    summary)``, the model's rows: those without an index count by their position
    from 1, of several for one image the last counts."""
    number = F.coalesce(F.nullif("index", F.lit(0)), F.col("pos"))
    last = seen.select(key, number.alias("index"), "pos", "summary").groupBy(key, "index").agg(F.max_by("summary", "pos").alias("summary"))
    return images.join(last, [key, "index"], "left").withColumn("summary", F.trim(F.coalesce("summary", F.lit(""))))


def ocr_lines(images: DataFrame, key: str) -> DataFrame:
    """``key, ocr_text``: the texts read on all images of a question, one a line."""
    line = F.concat(F.lit("[image_"), F.col("index"), F.lit("] "), F.trim("ocr_text"))
    shown = images.where("trim(ocr_text) <> ''").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("index", line.alias("line")))).alias("x"))
    return shown.select(key, F.array_join(F.transform("x", lambda v: v["line"]), "\n").alias("ocr_text"))


def _filled(x: Column) -> Column:
    return F.trim(F.coalesce(x, F.lit(""))) != ""


def suggested_query(question: Column, *parts: Column, ocr_text: Column) -> Column:
    """Question, what the model saw, and the text read; distinct, one a line."""
    ocr = F.when(_filled(ocr_text), F.concat(F.lit("OCR: "), ocr_text))
    listed = F.filter(F.array(*[F.trim(p) for p in (question, *parts)], ocr), _filled)
    return F.array_join(F.array_distinct(listed), "\n")


def compact_context(observation: dict[str, Column], visible_parts: Column, images: Column | None = None) -> Column:
    """``label: value`` lines of the filled fields, the visible parts, and one line
    an image, given as an array of texts."""
    lines = [F.when(_filled(observation[k]), F.concat(F.lit(f"{label}: "), F.trim(observation[k]))) for k, label in CONTEXT_FIELDS if k in observation]
    parts = F.when(F.size(visible_parts) > 0, F.concat(F.lit("visible_parts: "), F.array_join(visible_parts, ", ")))
    all_lines = F.array(*lines, parts) if images is None else F.concat(F.array(*lines, parts), images)
    return F.array_join(F.filter(all_lines, lambda x: x.isNotNull()), "\n")


def image_line(index: Column, filename: Column, width: Column, height: Column, ocr_text: Column, summary: Column) -> Column:
    size = F.when((width > 0) & (height > 0), F.concat(F.lit("size="), width, F.lit("x"), height))
    named = lambda label, x: F.when(_filled(x), F.concat(F.lit(label), F.trim(x)))
    return F.concat_ws("; ", F.concat(F.lit("image_"), index), named("file=", filename), size, named("ocr=", ocr_text), named("vlm=", summary))


def augmented(question: Column, context: Column) -> Column:
    return F.when(_filled(context), F.concat(F.trim(question), F.lit("\n\nImage context:\n"), context)).otherwise(question)


def followup(question: Column, product: Column, code: Column, asked: Column | None = None) -> Column:
    """What to ask back about an unclear image: the model's words if it has any,
    else a text in the question's language that names what was seen."""
    clue = lambda sep: F.array_join(F.filter(F.array(F.trim(product), F.trim(code)), _filled), sep)
    zh = F.concat(F.lit("我看到图片中有 "), clue("、"), F.lit(" 这些线索，但还需要您补充产品名称、型号或想处理的具体目标，我再帮您继续判断。"))
    en = F.concat(F.lit("I can see "), clue(", "), F.lit(" in the image, but I still need the product model or your exact goal before proceeding."))
    none_zh = F.lit("我看到您上传了图片，但还需要您补充具体想咨询的问题、产品类型或使用场景，我再帮您继续处理。")
    none_en = F.lit("I can see the uploaded image, but I need your exact question or product context before proceeding.")
    text = F.when(question.rlike(T.CJK), F.when(clue("") != "", zh).otherwise(none_zh)).otherwise(F.when(clue("") != "", en).otherwise(none_en))
    return text if asked is None else F.when(_filled(asked), F.trim(asked)).otherwise(text)
