"""Column functions over paths and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of each class, lower case.
IMAGE = ("jpg", "jpeg", "jpe", "jfif", "png", "apng", "gif", "webp")
MODERN_IMAGE = ("heic", "heif", "hif", "avif", "avifs", "jxl")
RAW_IMAGE = ("cr2", "cr3", "crw", "nef", "nrw", "arw", "srf", "sr2", "dng", "raf", "orf", "rw2", "raw", "pef", "ptx", "srw", "3fr", "fff", "erf", "kdc", "dcr", "mrw", "x3f", "iiq", "mos", "rwl")
VIDEO = ("mp4", "m4v", "mov", "qt", "mkv", "webm", "avi", "wmv", "asf", "flv", "f4v", "mpg", "mpeg", "mpe", "m1v", "m2v", "mts", "m2ts", "ts", "mxf", "vob", "ogv", "3gp", "3g2", "rm", "rmvb", "divx", "dv")
AUDIO = ("mp3", "m4a", "m4b", "aac", "adts", "flac", "wav", "wave", "aif", "aiff", "aifc", "alac", "ogg", "oga", "opus", "wma", "ape", "wv", "amr", "mka", "dsf", "dff", "mp2", "ac3", "dts", "caf", "au")
# Names and extensions that are no assets.
SYSTEM_NAMES = (".ds_store", "thumbs.db", "desktop.ini", ".localized", "icon\r")
SIDECAR = ("xmp", "aae", "thm", "lrv", "pp3", "dop", "on1", "arp", "sfk")
SYSTEM_DIRS = (".trash", ".trashes", ".spotlight-v100", ".fseventsd", ".documentrevisions-v100", ".temporaryitems", ".mobilebackups", ".pcloud", "$recycle.bin", "system volume information")
BUNDLES = ("photoslibrary", "aplibrary", "migratedaplibrary", "photolibrary", "fcpbundle", "imovielibrary", "theater", "lrlibrary", "lrdata", "app", "framework", "bundle", "photoslibrarybundle")
# Image extensions that are compressed with loss already.
LOSSY = ("jpg", "jpeg", "jpe", "jfif", "webp", "heic", "heif", "hif", "avif", "jxl")

CLASSES = {"image": IMAGE, "modern_image": MODERN_IMAGE, "raw_image": RAW_IMAGE, "video": VIDEO, "audio": AUDIO}
KIND_ORDER = {"image": 0, "video": 1, "audio": 2}


def segments(path: Column) -> Column:
    """Non-empty components; arrays compare component by component, as paths do."""
    return F.filter(F.split(path, "/"), lambda s: s != "")


def path_key(path: Column) -> Column:
    """A sort key that orders paths by components: /a/b before /a-b."""
    return F.split(path, "/")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    cut = F.regexp_replace(path, r"/[^/]*\z", "")
    return F.when((cut == "") & path.startswith("/"), F.lit("/")).otherwise(cut)


def extension(path: Column) -> Column:
    """The part after the last dot of the name, '' if there is none or the name only begins with its dot."""
    return F.regexp_extract(file_name(path), r"(?s)^.+\.([^.]*)\z", 1)


def stem(path: Column) -> Column:
    name = file_name(path)
    return F.when(name.rlike(r"(?s)^.+\.[^.]*\z"), F.regexp_replace(name, r"\.[^.]*\z", "")).otherwise(name)


def classify(path: Column) -> Column:
    """The class of a file by its extension; null for what is no media."""
    ext = F.lower(extension(path))
    out = F.lit(None).cast("string")
    for name, members in CLASSES.items():
        out = F.when(ext.isin(*members), name).otherwise(out)
    return out


def media_kind(cls: Column) -> Column:
    return F.when(cls.isin("image", "modern_image", "raw_image"), "image").otherwise(cls)


def is_system_junk(name: Column) -> Column:
    return name.startswith("._") | F.lower(name).isin(*SYSTEM_NAMES)


def is_sidecar(name: Column) -> Column:
    """By what follows the last dot of the name, so a bare .xmp counts."""
    return name.contains(".") & F.lower(F.substring_index(name, ".", -1)).isin(*SIDECAR)


def is_junk(name: Column) -> Column:
    return is_system_junk(name) | is_sidecar(name)


def is_bundle(name: Column) -> Column:
    return name.contains(".") & F.lower(F.substring_index(name, ".", -1)).isin(*BUNDLES)


def is_skipped_dir(name: Column) -> Column:
    return F.lower(name).isin(*SYSTEM_DIRS) | is_bundle(name)


def needs_probe(cls: Column) -> Column:
    return cls.isin("video", "audio")


def is_hashable(cls: Column) -> Column:
    return media_kind(cls) == "image"


def accepts(cls: Column, mode: str) -> Column:
    """Files that a duplicate search of this mode takes: exact all, perceptual still images without RAW."""
    return F.lit(True) if mode == "exact" else cls.isin("image", "modern_image")


def is_temp_file(name: Column) -> Column:
    return name.startswith(".") & name.contains(".zz-") & name.endswith(".tmp")


def depth(path: Column) -> Column:
    """Number of components; the root of an absolute path counts as one."""
    return (F.size(segments(path)) + F.when(path.startswith("/"), 1).otherwise(0)).cast("long")


def root_label(root: Column) -> Column:
    """The last component of a root, or the root itself where it has none."""
    parts = segments(root)
    return F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise(root)


def target_ext(kind: Column) -> Column:
    return F.when(kind == "image", "avif").when(kind == "video", "mp4").when(kind == "audio", "m4a")


def is_under(path: Column, root: Column) -> Column:
    """Whether root is a prefix of path by whole components."""
    return (path == root) | F.startswith(path, F.concat(F.regexp_replace(root, "/$", ""), F.lit("/")))
