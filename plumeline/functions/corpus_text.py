"""Cleaning of product texts for the retrieval corpus. All rules are case-sensitive unless they say otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumeline.functions.scoped import let
from plumeline.functions.text import strip, unescape, unescape_each

# What garbled characters stand for.
GARBLED = {
    "Â ": " ", "Â’": "'", "Â“": '"', "Â”": '"', "Â®": "(R)", "Â™": "(TM)", "Â°": "deg", "Â½": "1/2", "Â¼": "1/4", "Â¾": "3/4",
    "â\u0080\u0099": "'", "â\u0080\u009c": '"', "â\u0080\u009d": '"', "â\u0080\u0093": "-", "â\u0080\u0094": "-", "â\u0080¦": "...", "Ã©": "e", "Ã¨": "e", "Ã ": "a",
    "Ã®": "i", "Ã±": "n", "ï¿½": "",
}
OTHER_SCRIPTS = r"[぀-ヿ一-鿿가-힯Ѐ-ӿͰ-Ͽ֐-׿؀-ۿ]"
# Sentences that say nothing of the product, matched whole, and phrases matched anywhere in either case.
EMPTY_SENTENCES = (
    r"Product Description\s*[:.\-]?", r"Product Details\s*[:.\-]?", r"From the Manufacturer\s*[:.\-]?", r"Brand Story\s*(?:By\s+[\w\s&\-'.]+)?\s*[:.\-]?", r"See more\s*\.?", r"Read more\s*\.?",
    r"""Click(?:\s+["'])?Add to Cart(?:\s+["'])?\s+now\.?""", r"Add to Cart(?:\s+now)?\.?", r"Order\s+Now(?:\s+Without\s+Risk)?\.?", r"Buy it now\.?", r"Don'?t hesitate(?:\s+any\s+more)?(?:,)?\s*buy it now\.?",
    r"Make these?\s+[\w\s]+part of your\s+[\w\s]+(?:daily\s+life|essentials?)\.?", r"24[\- ]?hour\s+friendly\s+customer\s+service\.?", r"24[\- ]?h\s+(?:friendly\s+)?customer\s+service\.?",
    r"We offer\s+24[\- ]?h(?:our)?\s+(?:friendly\s+)?(?:customer\s+)?service\.?", r"Worry[\- ]?free\s+after[\- ]?sales\.?", r"We (?:will )?(?:try|are committed) to (?:provide|solve|help).*?(?:customer service|issue|problem).*?\.?",
    r"For any reason you are not 100%\s+satisfied.*?\.?", r"If you (?:have any|are not).*?(?:question|issue|problem).*?please.*?\.?", r"Please do not hesitate to contact us.*?\.?", r"(?:Contact|Reach out to) us (?:at once|right away|now).*?\.?",
    r"We (?:offer|provide) 24h? service.*?\.?", r"It(?:'s| is) (?:really |so )?(?:a )?(?:great|good|nice|perfect|amazing) (?:gift|choice|option)(?:\s+for\s+(?:the\s+)?[\w\s]+)?\.?",
    r"The (?:perfect|ideal|best) (?:gift|choice|option) for\s+.*?\.?", r"Makes? (?:a )?(?:great|perfect|ideal) (?:gift|present)\.?", r"([A-Z][A-Z&\-]{2,}\s+){3,}[A-Z][A-Z&\-:]*\s*\.?",
)
EMPTY_PHRASES = (
    r"\bBrand Story\s+By\s+\S+(?:\s+\S+){0,3}\.?\s*", r"\bProduct Description\s*[:.\-]?\s*", r"\bFrom the Manufacturer\s*[:.\-]?\s*", r"\bSee more\.?\s*", r"\bRead more\.?\s*", r"""Click(?:\s+["'])?Add to Cart(?:\s+["'])?\s+now\.?""",
    r"Order Now Without Risk\.?", r"\bAdd to Cart\s+now\.?", r"\b24[\- ]?hour friendly customer service\.?", r"\bWorry[\- ]?free after[\- ]?sales\.?",
)
# Words that keep their capitals.
CAPITALS = (
    "BPA", "CPSIA", "FDA", "LFGB", "PVC", "PEVA", "PE", "PU", "PP", "USA", "UK", "EU", "USD", "TOG", "NICU", "TPU", "TPE", "DIY", "OEM", "ODM", "SGS", "CE", "ROHS", "USB", "AC", "DC", "LED", "LCD", "HD", "GPS", "XL", "XXL", "XS", "SM", "MD", "LG",
    "SIDS", "HALO", "ECR", "ECR4KIDS", "DCDC", "MICROFIBER", "MICROFIBRE", "POLYESTER", "NYLON", "COTTON", "SILICONE", "ALUMINUM", "ALUMINIUM", "STAINLESS", "STEEL", "WOOD", "METAL", "PLASTIC", "OZ", "ML", "LB", "LBS", "KG", "G", "CM", "MM", "IN",
    "INCH", "INCHES", "FT", "FEET", "YARD", "YDS",
)


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def plain_text(c: Column) -> Column:
    """One round of references, tags out, and anything but letters, digits, space and a few marks to a space."""
    return plain_marks(unescape(c, once=True))


def plain_marks(c: Column) -> Column:
    c = F.regexp_replace(c, "<[^>]*>", " ")
    return squeeze(F.regexp_replace(c, r"""[^\p{L}\p{N}\s\-_/.,:%&+()\[\]'"#]""", " "))


def fix_encoding(c: Column) -> Column:
    """Garbled pairs mended, stray lead characters and other scripts taken away."""

    def mended(v: Column) -> Column:
        out = v["c"]
        for bad, good in GARBLED.items():
            out = F.replace(out, F.lit(bad), F.lit(good))
        # Every pair begins with one of these, and few texts hold any.
        return F.when(v["c"].rlike("[ÂâÃï]"), F.regexp_replace(out, r"[Ââ](?!\S)", "")).otherwise(v["c"])

    return squeeze(F.regexp_replace(let(mended, c=c), OTHER_SCRIPTS, " "))


def split_sentences(c: Column) -> Column:
    return F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: strip(s) != "")


def without_marketing(c: Column) -> Column:
    """Sentences and phrases that say nothing, and addresses, taken away."""
    whole = r"^\s*(?:" + "|".join(EMPTY_SENTENCES) + r")\s*$"
    c = F.array_join(F.filter(split_sentences(c), lambda s: ~strip(s).rlike(whole)), " ")

    def without_phrases(v: Column) -> Column:
        out = v["c"]
        for phrase in EMPTY_PHRASES:
            out = F.regexp_replace(out, "(?i)" + phrase, " ")
        return F.when(v["c"].rlike("(?i)" + "|".join(EMPTY_PHRASES)), out).otherwise(v["c"])

    def without_addresses(v: Column) -> Column:
        out = F.regexp_replace(F.regexp_replace(v["c"], r"https?://\S+", " "), r"\bwww\.\S+", " ")
        return F.when(F.contains(v["c"], F.lit("http")) | F.contains(v["c"], F.lit("www.")), out).otherwise(v["c"])

    return squeeze(let(without_addresses, c=let(without_phrases, c=c)))


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))


def without_restated(text: Column, dimensions: Column, weight: Column, title: Column) -> Column:
    """Sentences that only repeat the dimensions, the weight or the title taken away."""

    def restates(s: Column, found: Column, known: Column) -> Column:
        in_size = F.size(F.filter(found, lambda n: F.array_contains(known["size"], n)))
        size = (F.size(found) >= 2) & (in_size >= F.greatest(F.lit(2), F.floor(F.size(found) * 0.8)))
        heavy = (F.size(found) == 1) & F.array_contains(known["weight"], found[0]) & (F.length(s) < 60)
        named = (F.length(known["title"]) >= 20) & F.contains(F.lower(s), F.lower(known["title"])) & (F.length(s) <= F.floor(F.length(known["title"]) * 1.5))
        return F.coalesce(size, F.lit(False)) | F.coalesce(heavy, F.lit(False)) | F.coalesce(named, F.lit(False))

    def kept(known: Column) -> Column:
        keep = lambda s: ~let(lambda v: restates(v["s"], v["found"], known), s=strip(s), found=numbers(s))
        return F.array_join(F.filter(known["sentences"], keep), " ")

    return squeeze(let(kept, sentences=split_sentences(text), size=numbers(dimensions), weight=numbers(weight), title=title))


def without_title(features: Column, title: Column) -> Column:
    """The features without the first one if it restates a title of fifteen characters or more."""
    first = strip(features[0])
    same = (F.length(title) >= 15) & F.contains(F.lower(first), F.lower(title)) & (F.length(first) <= F.floor(F.length(title) * 1.5))
    return F.when((F.size(features) > 0) & same, F.slice(features, F.lit(2), F.greatest(F.size(features) - 1, F.lit(0)))).otherwise(features)


def calm_capitals(line: Column) -> Column:
    """A line of 30 characters or more whose first five words shout is put in capitalised words, known acronyms excepted."""

    def shouting(v: Column) -> Column:
        head = F.slice(F.filter(v["words"], lambda w: w.rlike(r"\p{L}")), 1, 5)
        loud = F.filter(head, lambda w: F.regexp_count(w, F.lit(r"\p{Lu}")) >= F.regexp_count(w, F.lit(r"\p{L}")) - 1)
        return (F.length(v["line"]) >= 30) & (F.size(v["words"]) >= 3) & (F.size(head) >= 3) & (F.size(loud) >= 3)

    def calm(w: Column) -> Column:
        upper = w.rlike(r"\p{L}") & (w == F.upper(w))
        known = F.upper(F.regexp_replace(w, r"""^[.,:;()\[\]'"]+|[.,:;()\[\]'"]+$""", "")).isin(*CAPITALS)
        lowered = F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))
        return F.when(known, F.upper(w)).when(w.rlike(r"\p{Nd}") | (upper & (F.length(w) <= 4)) | ~upper, w).otherwise(lowered)

    def calmed(v: Column) -> Column:
        return F.when(shouting(v), F.array_join(F.transform(v["words"], calm), " ")).otherwise(v["line"])

    return let(lambda x: let(calmed, line=x["line"], words=F.filter(F.split(x["line"], r"\s+"), lambda w: w != "")), line=line)  # the line is read twice


def clean_field(c: Column) -> Column:
    return fix_encoding(without_marketing(plain_text(c)))


def clean_categories(categories: Column) -> Column:
    """The cleaned categories, ` / ` between them; null ones are left out."""
    known = F.filter(unescape_each(categories), lambda c: c.isNotNull())
    return F.array_join(F.transform(known, lambda c: fix_encoding(without_marketing(plain_marks(c)))), " / ")


def clean_description(c: Column, dimensions: Column, weight: Column, title: Column) -> Column:
    return calm_capitals(without_restated(clean_field(c), dimensions, weight, title))


def clean_features(features: Column, title: Column) -> Column:
    """`#1: ...`, `#2: ...`: cleaned, without empty ones and without a first one that restates the title."""
    made = F.filter(F.transform(unescape_each(features), lambda f: fix_encoding(without_marketing(plain_marks(f)))), lambda f: f != "")
    left = let(lambda v: without_title(v["made"], v["title"]), made=made, title=title)
    return F.transform(left, lambda f, i: F.concat(F.lit("#"), i + 1, F.lit(": "), f))


def document(title: Column, brand: Column, category: Column, dimensions: Column, weight: Column, description: Column, features: Column) -> Column:
    """The lines of a product's document; empty fields have none."""

    def line(name: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(f"{name}: "), value))

    def lines(v: Column) -> Column:
        listed = F.when(F.size(v["features"]) > 0, F.concat(F.lit("features:\n"), F.array_join(v["features"], "\n")))
        return F.concat_ws("\n", F.concat(F.lit("product: "), v["title"]), *[line(name, v[name]) for name in ("brand", "category", "dimensions", "weight", "description")], listed)

    return let(lines, title=title, brand=brand, category=category, dimensions=dimensions, weight=weight, description=description, features=features)
