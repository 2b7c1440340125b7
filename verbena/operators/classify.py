"""Formats of files and types of resources, from tables of rules joined to candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbena.functions.text import fold

#: Extension:format by storage category (the format is the extension where none is given).
EXTENSIONS = {
    "text": "txt:text md:markdown rtf srt:subtitles vtt:subtitles csv tsv json jsonl xml yaml yml:yaml toml html htm:html tex:latex bib:bibtex "
    "eaf:elan pfsx:elan-prefs textgrid:praat-textgrid flextext:flex-text fwdata:flex-project fwbackup:flex-backup lift db:toolbox-or-sqlite sfm:toolbox-sfm tbx:toolbox "
    "conllu:conll-u conll xigt tei trs:transcriber cha:chat exb:exmaralda ann:brat ipa:text lex:lexicon-text dic:dictionary-text aff:hunspell",
    "documents": "pdf doc:msword docx odt ppt:powerpoint pptx odp xls:excel xlsx ods epub djvu ps:postscript",
    "audio": "wav mp3 flac ogg oga:ogg m4a aac wma aiff aif:aiff opus amr",
    "video": "mp4 mkv mov:quicktime avi webm wmv mpg:mpeg mpeg m4v 3gp mts:avchd",
    "images": "png jpg:jpeg jpeg tif:tiff tiff gif bmp svg webp heic psd:photoshop",
    "archives": "zip tar gz:gzip tgz:tar-gzip bz2:bzip2 xz 7z rar iso:iso-image",
    "other": "parquet sqlite sqlite3:sqlite h5:hdf5 hdf5 npz:numpy pkl:pickle ttf:font-truetype otf:font-opentype woff:font-woff woff2:font-woff2 kmn:keyman-keyboard kmp:keyman-package "
    "klc:ms-keyboard-layout keylayout:mac-keyboard-layout py:source-python js:source-javascript sh:source-shell r:source-r exe:executable apk:android-package jar:java-archive",
}
#: First bytes in hexadecimal, format, category; the first that fits counts.
MAGIC = (
    ("25504446", "pdf", "documents"), ("504B0304", "zip", "archives"), ("1F8B", "gzip", "archives"), ("377ABCAF271C", "7z", "archives"), ("52617221", "rar", "archives"),
    ("52494646", "wav", "audio"), ("494433", "mp3", "audio"), ("664C6143", "flac", "audio"), ("4F676753", "ogg", "audio"), ("89504E47", "png", "images"), ("FFD8FF", "jpeg", "images"),
    ("47494638", "gif", "images"), ("49492A00", "tiff", "images"), ("4D4D002A", "tiff", "images"), ("1A45DFA3", "mkv", "video"), ("53514C69746520666F726D61742033", "sqlite", "other"), ("D0CF11E0", "ms-office-legacy", "documents"),
)
#: Extensions of packages that are zip files inside.
PACKAGES = ("docx", "xlsx", "pptx", "odt", "ods", "odp", "epub", "kmp", "jar", "apk")
#: Resource types.
TYPES = (
    "dictionary", "lexicon", "wordlist", "corpus", "grammar", "phonology", "morphology", "syntax", "orthography", "translation", "parallel_text",
    "transcription", "interlinear_text", "audio", "video", "image", "field_notes", "research", "metadata", "software", "archive", "unknown",
)
#: Words by the type they hint at.
KEYWORDS = {
    "dictionary": "dictionary,dict,dictionar", "lexicon": "lexicon,lexique,lexical", "wordlist": "wordlist,word list,swadesh,vocabulary,vocab",
    "corpus": "corpus,corpora,texts,story,stories,narrative,folktale", "grammar": "grammar,grammatical,sketch", "phonology": "phonology,phonological,phonetic,tone",
    "morphology": "morphology,morphological,verb", "syntax": "syntax,syntactic,clause", "orthography": "orthography,alphabet,spelling,primer,writing system",
    "translation": "translation,translated,bible,gospel,new testament", "parallel_text": "parallel,bitext,aligned", "transcription": "transcription,transcript",
    "interlinear_text": "interlinear,glossed,igt,flextext", "field_notes": "field notes,fieldnotes,notebook,elicitation",
    "research": "thesis,dissertation,paper,article,journal,proceedings,survey", "metadata": "metadata,imdi,cmdi,olac", "software": "keyboard,font,keyman,software", "audio": "song,recording,interview",
}
#: Formats by the type they imply, and categories by theirs.
FORMAT_TYPES = {
    "transcription": "elan praat-textgrid transcriber chat exmaralda subtitles", "interlinear_text": "flex-text xigt", "corpus": "conll-u conll",
    "dictionary": "lift toolbox-sfm toolbox dictionary-text", "lexicon": "lexicon-text", "wordlist": "hunspell", "metadata": "bibtex",
    "software": "font-truetype font-opentype font-woff font-woff2 keyman-keyboard keyman-package ms-keyboard-layout mac-keyboard-layout source-python source-javascript source-shell source-r executable android-package java-archive",
}
CATEGORY_TYPES = {"audio": "audio", "video": "video", "images": "image", "archives": "archive"}


def extension_table() -> list[tuple[str, str, str]]:
    """extension, format, category"""
    out = []
    for category, listed in EXTENSIONS.items():
        for item in listed.split():
            extension, _, fmt = item.partition(":")
            out.append((extension, fmt or extension, category))
    return out


def keyword_table() -> list[tuple[str, str]]:
    return [(word, kind) for kind, words in KEYWORDS.items() for word in words.split(",")]


def extension(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.endswith(".tar.gz"), "tgz").otherwise(F.regexp_extract(F.regexp_replace(n, r"^.*[/\\]", ""), r"[^.]\.([^.]+)$", 1))


def detect_format(files: DataFrame) -> DataFrame:
    """files (name, head: the first bytes, may be null) with format, category, extension and detected_by.

    Both tables of rules are small constants, written into the expression: no join.
    """
    ext = F.col("extension")
    rules = extension_table()
    by_ext = F.create_map(*(F.lit(x) for e, f, c in rules for x in (e, f"{f}/{c}")))[ext]
    head = F.hex(F.substring(F.coalesce("head", F.lit(b"")), 1, 16))
    magic = F.lit(None).cast("string")
    for signature, fmt, category in reversed(MAGIC):
        magic = F.when(head.startswith(signature), f"{fmt}/{category}").otherwise(magic)
    magic = F.when(magic.startswith("zip/") & ext.isin(*PACKAGES), F.lit(None)).otherwise(magic)
    size = F.length(head) / 2
    control = F.length(F.regexp_replace(head, r"(?:0[0-8BCEF]|1[0-9A-F]|7F)|(..)", "$1")) / 2
    printable = (size > 0) & ~head.rlike(r"^(?:..)*00") & (control / size > 0.9)
    f = files.withColumn("extension", extension(F.col("name"))).withColumn("x", by_ext).withColumn("m", magic)
    kind = F.coalesce("x", "m", F.when(printable, "text/text"), F.lit("unknown/other"))
    by = F.when(F.col("x").isNotNull() & F.col("m").isNotNull(), "extension+magic").when(F.col("x").isNotNull(), "extension").when(F.col("m").isNotNull(), "magic").when(printable, "content").otherwise("unknown")
    return f.withColumns({"format": F.split_part(kind, F.lit("/"), F.lit(1)), "category": F.split_part(kind, F.lit("/"), F.lit(2)), "detected_by": by}).drop("x", "m")


def classify(spark: SparkSession, resources: DataFrame, key: str = "resource_id") -> DataFrame:
    """key, type, confidence: all types of each resource, each with its best rule.

    resources: key, format, category, words (names, titles and descriptions, joined), hints (array). No rule gives research for
    documents, unknown for the rest.
    """
    blob = F.concat(F.lit(" "), fold(F.col("words")), F.lit(" "))
    words = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(t).alias("t")) for w, t in keyword_table()))
    by_format = F.create_map(*(F.lit(x) for t, fs in FORMAT_TYPES.items() for f in fs.split() for x in (f, t)))[F.col("format")]
    by_category = F.create_map(*(F.lit(x) for c, t in CATEGORY_TYPES.items() for x in (c, t)))[F.col("category")]
    # only a resource's own rows are made: a few rules each, no join with the rules
    found = F.filter(words, lambda k: F.contains(blob, F.concat(F.lit(" "), k["w"], F.lit(" "))) | F.contains(blob, F.concat(F.lit(" "), k["w"], F.lit("s "))) | ((F.length(k["w"]) > 6) & F.contains(blob, k["w"])))
    rule = lambda t, c: F.struct(t.alias("type"), F.lit(c).alias("confidence"))

    def hinted(h: Column) -> Column:
        exact = F.replace(fold(h), F.lit(" "), F.lit("_"))
        loose = F.transform(F.filter(words, lambda k: F.contains(fold(h), k["w"])), lambda k: rule(k["t"], 0.6))
        return F.when(exact.isin(*TYPES), F.array(rule(exact, 0.8))).otherwise(loose)

    hints = F.flatten(F.transform(F.coalesce("hints", F.array().cast("array<string>")), hinted))
    one = lambda t, c: F.when(t.isNotNull(), F.array(rule(t, c))).otherwise(F.array().cast("array<struct<type:string,confidence:double>>"))
    rules = F.concat(one(by_format, 0.9), one(by_category, 0.95), F.transform(found, lambda k: rule(k["t"], 0.7)), hints)
    rules = F.when(F.size(rules) > 0, rules).when(F.col("category") == "documents", F.array(rule(F.lit("research"), 0.3))).otherwise(F.array(rule(F.lit("unknown"), 0.5)))
    return resources.select(key, F.explode(rules).alias("r")).groupBy(key, F.col("r.type").alias("type")).agg(F.max("r.confidence").alias("confidence"))
