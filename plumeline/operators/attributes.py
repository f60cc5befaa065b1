"""Product attributes: extraction from metadata, choice of the best ones, prompts and content checks.

An attribute list is array<struct<pos,key,value>>: its order is data. All steps work inside a product's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeline.functions.scoped import let
from plumeline.functions.text import WORD, split_camel, strip

# Key lists of the attribute rules.
YES_NO = ("yes", "no", "true", "false")
NUMERIC_KEYS = ("price", "average rating", "rating number", "item weight", "item model number", "date first available", "package dimensions", "product dimensions", "minimum weight recommendation", "maximum weight recommendation", "batteries required", "is discontinued by manufacturer")
PLAIN_KEYS = ("main category", "department", "country", "country of origin", "country/region of origin", "number of items", "number of pieces", "unit count", "date", "date listed", "best sellers rank")
PRIORITY = (
    "Brand", "Main Category", "Item model number", "Manufacturer", "Color", "Material", "Material Type", "Fabric Type", "Frame Material", "Item Weight", "Product Dimensions", "Size", "Style", "Pattern", "Theme",
    "Age Range (Description)", "Special Feature", "Target gender", "Batteries required", "Number Of Items", "Is Discontinued By Manufacturer", "Date First Available", "Country/Region of origin", "Country of Origin", "Price", "Average Rating", "Rating Number",
)
BRAND_KEYS = ("brand", "manufacturer", "item model number")

DIGIT = r"[\p{Nd}²³¹⁰-⁹₀-₉]"
CJK = r"[一-鿿぀-ヿ가-힯]"


def attribute(pos: Column, key: Column, value: Column) -> Column:
    return F.struct(pos.cast("int").alias("pos"), key.alias("key"), value.alias("value"))


def raw_attributes(details: Column, features: Column, brand: Column, category: Column, numbers: dict[str, Column]) -> Column:
    """Everything metadata says, in order: details of 1 to 200 characters, features by their place, fallbacks, numbers."""
    named = F.filter(F.transform(details, lambda d: attribute(d["pos"], d["key"], strip(d["value"]))), lambda d: d["value"].isNotNull() & F.length(d["value"]).between(1, 200))
    listed = F.filter(F.transform(features, lambda f, i: attribute(1000 + i, F.concat(F.lit("Feature "), i + 1), strip(f))), lambda d: d["value"].isNotNull() & (d["value"] != ""))
    out = F.concat(named, listed)
    for place, (key, value) in enumerate({"Brand": brand, "Main Category": category}.items()):
        extra = F.array(attribute(F.lit(2000 + place), F.lit(key), strip(value)))
        usable = value.isNotNull() & (strip(value) != "")
        out = let(lambda v: F.when(usable & ~F.exists(v["out"], lambda d: d["key"] == key), F.concat(v["out"], extra)).otherwise(v["out"]), out=out)  # noqa: B023
    more = [attribute(F.lit(3000 + i), F.lit(k), v.cast("string")) for i, (k, v) in enumerate(numbers.items())]
    return F.concat(out, F.filter(F.array(*more), lambda d: d["value"].isNotNull())) if more else out


def _speaks(d: Column) -> Column:
    """At most three words, not a yes or no, Latin letters in key and value."""
    plain = ~F.lower(d["value"]).isin(*YES_NO)
    return (F.regexp_count(d["value"], F.lit(r"\S+")) <= 3) & plain & d["value"].rlike("[A-Za-z]") & d["key"].rlike("[A-Za-z]") & ~d["value"].rlike(CJK)


def extracted(raw: Column) -> Column:
    """The rules in their order: no digits, first of equal values, at most three words that speak, first part of a comma list."""
    wordy = F.filter(raw, lambda d: ~d["value"].rlike(DIGIT))

    def first_of_equal(v: Column) -> Column:
        return let(lambda u: F.filter(v["wordy"], lambda d, i: F.array_position(u["keys"], u["keys"][i]) == i + 1), keys=F.transform(v["wordy"], lambda d: F.lower(strip(d["value"]))))

    spoken = F.filter(let(first_of_equal, wordy=wordy), _speaks)
    cut = F.transform(spoken, lambda d: attribute(d["pos"], d["key"], strip(F.split_part(d["value"], F.lit(","), F.lit(1)))))
    return F.filter(cut, lambda d: (d["value"] != "") & _speaks(d))


def product_attributes(meta: DataFrame, least: int = 5) -> DataFrame:
    """(asin, attrs) of products with at least `least` attributes; the key is parent_asin, else asin, and neither drops the row."""
    asin = F.coalesce(F.nullif(F.col("parent_asin"), F.lit("")), F.nullif(F.col("asin"), F.lit("")))
    numbers = {"Average Rating": F.col("average_rating"), "Rating Number": F.col("rating_number"), "Price": F.col("price")}
    raw = raw_attributes(F.col("details"), F.col("features"), F.col("brand"), F.col("main_category"), numbers)
    # Generated, so that each step is computed once and not in every place that reads it.
    rows = meta.select(asin.alias("asin"), "line_no", F.explode(F.array(raw)).alias("raw")).filter("asin is not null")
    rows = rows.select("asin", "line_no", F.explode(F.array(extracted(F.col("raw")))).alias("attrs"))
    last = rows.groupBy("asin").agg(F.max_by("attrs", "line_no").alias("attrs"))
    return last.filter(F.size("attrs") >= least)


def top_attributes(attrs: Column, n: int = 5, value_limit: int = 100) -> Column:
    """The n best: keys of the priority list first, in its order, then the others as they come."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(PRIORITY) for x in (k, i)])
    banned = "|".join(k.replace("/", r"\/") for k in NUMERIC_KEYS + PLAIN_KEYS)
    usable = F.filter(attrs, lambda d: (strip(d["value"]) != "") & (F.length(strip(d["value"])) <= value_limit) & ~F.lower(d["key"]).rlike(banned) & ~d["value"].rlike(DIGIT))
    ordered = F.array_sort(F.transform(usable, lambda d: F.struct(F.coalesce(F.try_element_at(rank, d["key"]), F.lit(1000)).alias("rank"), d["pos"].alias("pos"), d["key"].alias("key"), strip(d["value"]).alias("value"))))
    return F.transform(F.slice(ordered, 1, n), lambda d: attribute(d["pos"], d["key"], d["value"]))


def clean_value(d: Column) -> Column:
    """The value with stuck words split; brands stay as they are."""
    return F.when(F.lower(d["key"]).isin(*BRAND_KEYS), strip(d["value"])).otherwise(split_camel(d["value"]))


def word_text(value: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(value), F.lit(WORD), F.lit(0)), " ")


def clean_attributes(attrs: Column, n: int = 5) -> Column:
    """The first n cleaned values of 1 to 30 characters of words, without single words over ten characters that had no space."""
    made = F.transform(attrs, lambda d: F.struct(d["pos"].alias("pos"), d["key"].alias("key"), clean_value(d).alias("value"), d["value"].alias("raw"), word_text(clean_value(d)).alias("words")))
    stuck = lambda d: ~d["words"].contains(" ") & ~d["raw"].contains(" ") & (F.length(d["raw"]) > 10)
    kept = F.filter(made, lambda d: (d["words"] != "") & (F.length(d["words"]) <= 30) & ~stuck(d))
    return F.transform(F.slice(kept, 1, n), lambda d: attribute(d["pos"], d["key"], d["value"]))


def prompt(attrs: Column) -> Column:
    listed = F.array_join(F.transform(attrs, lambda d: F.concat(d["key"], F.lit(": "), d["value"])), "; ")
    return F.concat(F.lit("Write one search query of 5-20 words for a product with these "), F.size(attrs), F.lit(" known attributes: "), listed)


def content_check(query: Column, attrs: Column) -> dict[str, Column]:
    """missing keys, whether a word repeats, words of no attribute, and pass (nothing missing, nothing repeated)."""
    tokens = F.regexp_extract_all(F.lower(query), F.lit(WORD), F.lit(0))
    normal = F.array_join(tokens, " ")
    missing = F.transform(F.filter(attrs, lambda d: ~F.contains(normal, word_text(d["value"]))), lambda d: d["key"])
    repeated = F.size(tokens) != F.size(F.array_distinct(tokens))
    known = F.flatten(F.transform(attrs, lambda d: F.regexp_extract_all(F.lower(d["value"]), F.lit(WORD), F.lit(0))))
    extras = F.filter(tokens, lambda t: ~F.array_contains(known, t))
    return {"missing": missing, "repeated": repeated, "extras": extras, "passed": (F.size(missing) == 0) & ~repeated}


def covers(query: Column, attrs: Column) -> Column:
    """Whether a query holds the words of every attribute."""
    normal = word_text(query)
    return F.forall(attrs, lambda d: F.contains(normal, word_text(d["value"])))
