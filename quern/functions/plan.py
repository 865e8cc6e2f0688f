"""How a file would be encoded: which route, with which settings. Column builders over options, so that a plan is made for
every row, whether or not the encoders are at hand where it runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import registry as R
from quern.functions.sizes import jpeg_qfactor, parse_size, pdf_profile, png_speed

#: Which packers take which option, besides those that every packer takes (fixed values).
OPTION_OF = {
    "keep_meta": "jpg png svg xml pdf flac m4a ape oga ogg mp3", "ultra": "png xml parquet pdf mp3", "jpeg_quality": "jpg xml pdf ai", "png_quality": "png xml",
    "pdf_profile": "pdf ai", "wmv_lossless": "wmv mp4 avi asf mkv webm mov m4v 3gp ts mts m2ts", "convert_container": "wmv mp4 avi asf 3gp ts mts m2ts",
}
#: Options by another name at the packer.
PACKER_NAME = {"wmv_lossless": "lossless"}
#: Containers that a video stays in, those it may stay in, and what the result is checked as.
OWN_CONTAINER, OTHER_CONTAINER = "mp4 mkv webm mov m4v".split(), "3gp ts mts m2ts".split()
CHECK_AS = {"mp4": "mp4 mov m4v 3gp", "ts": "ts mts m2ts", "mkv": "mkv", "webm": "webm"}


def options_of(packer: Column) -> Column:
    """Names, as the packer knows them, of the options that go to it."""
    taken = [F.when(packer.isin(kinds.split()), F.lit(PACKER_NAME.get(name, name))) for name, kinds in OPTION_OF.items()]
    return F.filter(F.array(*taken), lambda x: x.isNotNull())


def extract_limits(asked: Column) -> Column:
    """struct<bytes, ratio> of a limit given as text: null leaves both at their defaults (null), a size of zero switches
    both off, any other size sets the bytes and leaves the ratio."""
    size = parse_size(asked)
    ratio = F.when(asked.isNotNull() & (size == 0), F.lit(0.0))
    return F.struct(F.when(asked.isNotNull(), size).alias("bytes"), ratio.alias("ratio"))


def pdf_plan(lossy: Column, profile: Column, quality: Column) -> Column:
    """struct<route, profile, qfactor>, null for an unknown profile. Lossy, by Ghostscript first and qpdf where that
    fails, if asked for or if a profile or a quality is given; else lossless, by qpdf after the images."""
    known = pdf_profile(profile)
    by_gs = F.coalesce(lossy, F.lit(False)) | profile.isNotNull() | quality.isNotNull()
    plan = F.struct(F.when(by_gs, "gs, qpdf").otherwise("images, qpdf").alias("route"), F.when(by_gs, F.coalesce(known, F.lit(R.PDF_PROFILE))).alias("profile"), F.when(by_gs & quality.isNotNull(), jpeg_qfactor(quality)).alias("qfactor"))
    return F.when(profile.isNull() | known.isNotNull(), plan)


def jpg_plan(lossy: Column, quality: Column, keep_meta: Column) -> Column:
    """struct<steps, quality, metadata>: lossless optimising comes first unless the image is to lose quality."""
    down = F.coalesce(lossy, F.lit(False)) | quality.isNotNull()
    return F.struct(
        F.when(down, F.array(F.lit("jpegoptim"))).otherwise(F.array(F.lit("jpegtran"), F.lit("jpegoptim"))).alias("steps"),
        F.when(down, F.coalesce(quality, F.lit(R.JPEG_QUALITY))).alias("quality"), F.when(keep_meta, "all").otherwise("none").alias("metadata"))


def png_plan(lossy: Column, quality: Column, ultra: Column) -> Column:
    """struct<candidates, speed>: one quantiser if lossy, else the encoders of which the smallest output is taken."""
    down = F.coalesce(lossy, F.lit(False)) | quality.isNotNull()
    lossless = F.when(ultra, F.array(F.lit("oxipng"), F.lit("zopflipng"))).otherwise(F.array(F.lit("oxipng")))
    return F.struct(F.when(down, F.array(F.lit("pngquant"))).otherwise(lossless).alias("candidates"), F.when(down, png_speed(quality)).alias("speed"))


def video_plan(path: Column, mode: Column, convert: Column, lossless: Column) -> Column:
    """struct<container, dest, moved, codec, crf, preset, faststart, check>. A video moves to MP4, and its name with it, if
    its container is none to stay in and converting is on."""
    moves = F.coalesce(convert, F.lit(True)) & ~mode.isin(OWN_CONTAINER)
    container = F.when(moves | ~mode.isin(OWN_CONTAINER + OTHER_CONTAINER), "mp4").otherwise(mode)
    dest = F.when(moves, F.concat(F.regexp_replace(path, r"\.[^.]*$", ""), F.lit(".mp4"))).otherwise(path)
    webm, full = container == "webm", F.coalesce(lossless, F.lit(False))
    check = F.coalesce(*[F.when(container.isin(kinds.split()), F.lit(k)) for k, kinds in CHECK_AS.items()])
    return F.struct(
        container.alias("container"), dest.alias("dest"), (dest != path).alias("moved"), F.when(webm, "libvpx-vp9").otherwise("libx264").alias("codec"),
        F.when(~full, F.lit(18)).when(~webm, F.lit(0)).alias("crf"), F.when(~webm, F.when(full, "veryslow").otherwise("slow")).alias("preset"),
        container.isin("mp4", "mov", "m4v").alias("faststart"), check.alias("check"))


def archive_writer(key: Column, family: Column) -> Column:
    """How an archive is put together: a tar and a stream around it, Office packages as ZIP without extra fields, else by
    its own family."""
    return F.when(family.startswith("tar."), F.concat(F.lit("tar, "), F.substring_index(family, ".", -1))).when((family == "zip") & key.isin(R.SENSITIVE), "zip, bare").otherwise(family)


#: Codecs that an encoder's description of a sound file is searched for; the first of this order that it names counts.
SOUND_CODECS = "alac aac flac wavpack tta ape vorbis opus mp3".split()


def sound_codec(said: Column) -> Column:
    """The codec in a description (``Audio: flac, 44100 Hz``); empty if it names none."""
    lower = F.lower(said)
    return F.coalesce(*[F.when(F.contains(lower, F.lit(f"audio: {codec}")), codec) for codec in SOUND_CODECS], F.lit(""))


def sound_gate(codec: Column, allowed: list[str]) -> Column:
    """Whether a sound file may be encoded anew: its codec is one of ``allowed``, or could not be told."""
    return (codec == "") | codec.isin(allowed)


def cover_options(pack_images: Column, keep_meta: Column, lossy: Column, ultra: Column, jpeg_quality: Column, png_quality: Column) -> Column:
    """The options that go to images embedded in a sound file: switches default to off, but for packing images."""
    off = F.lit(False)
    return F.struct(
        F.coalesce(pack_images, F.lit(True)).alias("pack_images"), F.coalesce(keep_meta, off).alias("keep_meta"), F.coalesce(lossy, off).alias("lossy"), F.coalesce(ultra, off).alias("ultra"),
        jpeg_quality.alias("jpeg_quality"), png_quality.alias("png_quality"))
