"""What is known of a video from its options, its header and its file's name: exact rates, precedence, formats a codec takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest number of the rate, count and side parsers. Fixed value.
LARGEST = (1 << 32) - 1
#: Format names by their parts, in the order in which a file's name is searched for them. Fixed values.
FAMILIES = ("yuv420p", "yuv422p", "yuv444p", "gray")
DEPTHS = tuple(range(16, 8, -1))
OTHERS = ("gbrp8", "gbrp", "rgb24", "i420", "i422", "i444")
#: Depths that the codecs take of 4:2:0, 4:2:2 and 4:4:4, and formats beside these. Fixed values.
ACCEPTED = {"av2": ((8, 10), ("gbrp8", "rgb24")), "vvc": ((8, 9, 10, 11, 12), ("gbrp8",))}


def format_tokens() -> list[str]:
    """The names of formats, each before its own beginnings."""
    out = []
    for family in FAMILIES:
        for depth in DEPTHS:
            out += [f"{family}{depth}le", f"{family}{depth}"]
        out += [f"{family}8"] + [family] * (family != "gray")
    return [*out, *OTHERS, *(f"i{chroma}{depth:02}" for chroma in (0, 2, 4) for depth in DEPTHS)]


def parse_pixel_format(name: Column) -> Column:
    """struct(sampling, depth, name) of a pixel format's name in its plain form; null where there is no such format.

    Samplings are 420, 422, 444, 400 (gray), gbr (planar) and rgb (packed); depths are 8 to 16 bits.
    """
    f = F.lower(F.trim(name))
    yuv, gray, short = r"^yuv(420|422|444)p([0-9]*)(?:le)?$", r"^(?:gray|y)([0-9]*)(?:le)?$", r"^i([024])([0-9]{2})$"
    plain = {"i420": "420", "i422": "422", "i444": "444"}
    chroma = F.regexp_extract(f, short, 1)
    sampling = F.when(f.isin("gbrp", "gbrp8"), "gbr").when(f == "rgb24", "rgb")
    for alias, s in plain.items():
        sampling = sampling.when(f == alias, s)
    sampling = sampling.when(f.rlike(yuv), F.regexp_extract(f, yuv, 1)).when(f.rlike(gray), "400")
    for digit, s in (("0", "420"), ("2", "422"), ("4", "444")):
        sampling = sampling.when(f.rlike(short) & (chroma == digit), s)
    digits = F.when(f.rlike(yuv), F.regexp_extract(f, yuv, 2)).when(f.rlike(gray), F.regexp_extract(f, gray, 1)).when(f.rlike(short) & ~f.isin(*plain), F.regexp_extract(f, short, 2)).otherwise("")
    depth = F.when(digits == "", F.lit(8)).otherwise(digits.try_cast("int"))
    good = sampling.isNotNull() & depth.between(8, 16)
    tail = F.concat(depth.cast("string"), F.when(depth > 8, "le").otherwise(""))
    plain_name = F.when(sampling == "gbr", "gbrp8").when(sampling == "rgb", "rgb24").when(sampling == "400", F.concat(F.lit("gray"), tail)).otherwise(F.concat(F.lit("yuv"), sampling, F.lit("p"), tail))
    return F.when(good, F.struct(sampling.alias("sampling"), depth.cast("long").alias("depth"), plain_name.alias("name")))


def _divisor(a: Column, b: Column) -> Column:
    """The greatest common divisor of two positive numbers below 2^63, by Euclid's steps (90 suffice)."""
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(90)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step, lambda s: s["a"])


def rate(text: Column) -> Column:
    """struct(num, den) of a frame rate, exact and in lowest terms: whole, decimal, or n/d of two whole numbers; null if it is none or not positive."""
    t = F.trim(text)
    whole, decimal, ratio = r"^[0-9]{1,10}$", r"^([0-9]{0,9})\.([0-9]{0,9})$", r"^([0-9]{1,10})/([0-9]{1,10})$"
    places = F.length(F.regexp_extract(t, decimal, 2))
    digits = F.concat(F.regexp_extract(t, decimal, 1), F.regexp_extract(t, decimal, 2))
    num = F.when(t.rlike(whole), t.try_cast("long")).when(t.rlike(ratio), F.regexp_extract(t, ratio, 1).try_cast("long")).when(t.rlike(decimal), digits.try_cast("long"))
    den = F.when(t.rlike(whole), F.lit(1).cast("long")).when(t.rlike(ratio), F.regexp_extract(t, ratio, 2).try_cast("long")).when(t.rlike(decimal), F.pow(F.lit(10), places).cast("long"))
    return F.transform(F.array(F.struct(num.alias("n"), den.alias("d"))), lambda r: F.when((r["n"] > 0) & (r["d"] > 0) & (~t.rlike(ratio) | ((r["n"] <= LARGEST) & (r["d"] <= LARGEST))), _reduced(r["n"], r["d"])))[0]


def _reduced(n: Column, d: Column) -> Column:
    return F.transform(F.array(_divisor(n, d)), lambda g: F.struct(F.expr("0L").alias("_")).withField("num", F.call_function("div", n, g)).withField("den", F.call_function("div", d, g)).dropFields("_"))[0]


def rates_match(declared: Column, actual: Column) -> Column:
    """Whether a declared rate, as text, is the actual one (a struct num, den): a whole number if that is the rate rounded, a
    ratio if it is the same, a decimal if it is within 1/100."""
    r = rate(declared)
    wide = lambda c: c.cast("decimal(20,0)")
    n, d, an, ad = wide(r["num"]), wide(r["den"]), wide(actual["num"]), wide(actual["den"])
    rounded = F.floor((actual["num"] + F.floor(actual["den"] / 2)) / actual["den"])
    same, near = n * ad == an * d, F.abs(n * ad - an * d) * 100 <= d * ad
    return F.when(F.instr(declared, "/") > 0, same).when(F.instr(declared, ".") > 0, near).otherwise(r["num"] == rounded)


def infer_metadata(files: DataFrame, name: str = "file") -> DataFrame:
    """files with width, height, format, frames and fps, as far as the file's name says them.

    The first WxH are the sides; a rate follows them as p<rate>, or after separators before another one or the ending, 2997 and its like
    in hundredths; frames are the first digits before an f; the format is the first known name, and yuv420p8 for .yuv files that
    have none. Without sides there is neither format nor rate. A side or count of 0 is none.
    """
    f, sides = F.col("_f"), r"(?:^|[^0-9])([0-9]+)x([0-9]+)"
    part = lambda pattern, k, of=f: F.nullif(F.regexp_extract(of, pattern, k), F.lit(""))
    number = lambda c: F.when(c.try_cast("long").between(1, LARGEST), c.try_cast("long"))
    d = files.withColumn("_f", F.lower(F.regexp_extract(F.col(name), r"[^/]*$", 0)))
    after = F.col("_after")
    found = F.coalesce(F.get(F.filter(F.array(*map(F.lit, format_tokens())), lambda t: F.contains(f, t)), F.lit(0)), F.when(f.endswith(".yuv"), "yuv420p8"))
    d = d.withColumns({"width": number(part(sides, 1)), "height": number(part(sides, 2)), "_after": F.regexp_extract(f, sides + r"(.*)$", 3), "_found": found})
    fps = number(F.coalesce(part(r"^p([0-9]+)", 1, after), part(r"^[_.\-]*([0-9]+)(?:\.yuv|\.y4m|_|-)", 1, after)))
    d = d.withColumns({"frames": number(part(r"(?:^|[^0-9])([0-9]+)f", 1)), "_fps": fps})
    rate_ = F.when((F.col("_fps") >= 1000) & (F.col("_fps") % 100 == 97), F.concat(F.floor(F.col("_fps") / 100).cast("string"), F.lit(".97"))).otherwise(F.col("_fps").cast("string"))
    known = F.col("width").isNotNull() & F.col("height").isNotNull()
    d = d.withColumns({"format": F.when(known, parse_pixel_format(F.col("_found"))["name"]), "fps": F.when(known, rate_)})
    return d.drop("_f", "_after", "_found", "_fps")


def resolved(options: Column, header: Column, named: Column) -> Column:
    """struct(width, height, format, fps) from structs of an explicit option, a file's header and its name, each null if there is none.

    Sides and format come together: an option's (its format may be the header's), else the header's, else the name's. A rate is the
    option's, else the header's, else the name's.
    """
    sides = lambda s: s["width"].isNotNull() & s["height"].isNotNull()
    pick = lambda c: F.when(sides(options), options[c]).when(sides(header), header[c]).when(sides(named), named[c])
    form = F.when(sides(options), F.coalesce(options["format"], header["format"])).when(sides(header), header["format"]).otherwise(named["format"])
    return F.struct(pick("width").alias("width"), pick("height").alias("height"), form.alias("format"), F.coalesce(options["fps"], header["fps"], named["fps"]).alias("fps"))


def accepts(codec: Column, sampling: Column, depth: Column, name: Column) -> Column:
    """Whether a codec takes a format."""
    out = F.lit(False)
    for c, (depths, others) in ACCEPTED.items():
        out = F.when(codec == c, name.isin(*others) | (sampling.isin("420", "422", "444") & depth.isin(*depths))).otherwise(out)
    return out


def codec_format(codec: Column, name: Column) -> Column:
    """The format that a codec is given for a source's: its own if taken, gbrp8 for rgb24, else the same sampling at 8 bits if that is taken, else its own."""

    def given(f: Column) -> Column:
        eight = F.when(f["sampling"].isin("420", "422", "444"), F.concat(F.lit("yuv"), f["sampling"], F.lit("p8"))).when(f["sampling"] == "400", "gray8")
        lower = (f["depth"] > 8) & accepts(codec, f["sampling"], F.lit(8), eight)
        planar = (f["name"] == "rgb24") & accepts(codec, F.lit("gbr"), F.lit(8), F.lit("gbrp8"))
        return F.when(accepts(codec, f["sampling"], f["depth"], f["name"]), f["name"]).when(planar, "gbrp8").when(lower, eight).otherwise(f["name"])

    return F.transform(F.array(parse_pixel_format(name)), given)[0]


def endpoint(text: Column) -> Column:
    """struct(codec, path) of codec:path; null if either is missing."""
    at = F.instr(text, ":")
    return F.when((at > 1) & (at < F.length(text)), F.struct(F.substring_index(text, ":", 1).alias("codec"), F.substr(text, at + 1).alias("path")))


def setting(text: Column) -> Column:
    """struct(name, value) of name=value; a bare name is true."""
    at = F.instr(text, "=")
    return F.struct(F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(text).alias("name"), F.when(at > 0, F.substr(text, at + 1)).otherwise("true").alias("value"))


def switch(value: Column) -> Column:
    """The boolean of a setting's value; another value raises."""
    return F.when(value.isin("true", "1", "yes", "on"), True).when(value.isin("false", "0", "no", "off"), False).otherwise(F.raise_error(F.concat(F.lit("expects true or false, got "), value)).cast("boolean"))
