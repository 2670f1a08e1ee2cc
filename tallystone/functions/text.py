"""Names, addresses, contacts and identifiers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "[一-龥]"
#: Any blank, Unicode ones too, as a class of a pattern.
BLANK = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Letters and digits of any script, and the underscore, inside a class of a pattern.
WORD = r"\p{L}\p{N}_"
#: Mail domains that say nothing about a company.
PUBLIC_DOMAINS = [
    "qq.com", "163.com", "126.com", "sina.com", "sohu.com", "hotmail.com", "gmail.com", "outlook.com", "foxmail.com", "yeah.net", "139.com", "189.cn", "aliyun.com", "wo.cn",
    "vip.qq.com", "vip.163.com", "tom.com", "21cn.com", "188.com", "2980.com", "263.net", "mail.com", "yahoo.com", "live.com", "icloud.com", "me.com", "msn.com",
]


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def normal_name(text: Column) -> Column:
    return F.regexp_replace(strip_html(text), "[\\s　]+", "")


def normal_address(text: Column) -> Column:
    """An address without markup, blanks, punctuation, level names and postcodes; six digits that number a house or a room are no postcode."""
    bare = F.regexp_replace(normal_name(text), r"[,.;:，。；：、()（）\-#]", "")
    return F.regexp_replace(F.regexp_replace(bare, "特别行政区|自治区|省|市", ""), r"(?<!\d)\d{6}(?![\d号號室弄巷栋幢座楼层])", "")


def phones(text: Column) -> Column:
    """Mobile and landline numbers without country code, distinct in order of value.

    A landline of 11 or 12 digits with its area code also gives the number without
    its first three digits, so that numbers with and without the code meet.
    """
    bare = F.transform(F.split(strip_html(F.coalesce(text, F.lit(""))), r"(?:[,，;；、/]|" + BLANK + ")+"), lambda x: F.regexp_replace(x, r"[\-—()（）]", ""))
    local = F.transform(bare, lambda x: F.when(x.startswith("+86"), F.substring(x, 4, 1_000_000)).when(x.startswith("86") & (F.length(x) > 11), F.substring(x, 3, 1_000_000)).otherwise(x))
    known = F.filter(local, lambda x: x.rlike(r"^(?:1[3-9]\d{9}|0\d{9,11}|\d{7,8})$"))
    short = F.transform(F.filter(known, lambda x: x.rlike(r"^0\d{10,11}$")), lambda x: F.substring(x, 4, 1_000_000))
    return F.array_sort(F.array_distinct(F.concat(known, short)))


def emails(text: Column) -> Column:
    """Mail addresses in lower case, distinct in order of place; letters of any script count."""
    return F.array_distinct(F.regexp_extract_all(F.lower(strip_html(text)), F.lit(f"([{WORD}.+-]+@[{WORD}.-]+\\.[{WORD}]{{2,}})"), 1))


def private_domains(mails: Column) -> Column:
    return F.array_except(F.array_distinct(F.transform(mails, lambda m: F.substring_index(m, "@", -1))), F.lit(PUBLIC_DOMAINS))


def host(url: Column) -> Column:
    """Host of an address, lower case, without scheme, www. and port."""
    bare = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z]+://", "")
    return F.regexp_replace(F.regexp_extract(bare, r"^([^/?#:]*)", 1), r"^www\.", "")


def join_broken_cjk(text: Column) -> Column:
    return F.regexp_replace(text, f"(?<={CJK})\\s+(?={CJK})", "")


def clean_title(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "</?em[^>]*>", ""), "[《》<>〈〉]", ""))


def safe_filename(*parts: Column, extension: str) -> Column:
    return F.concat(F.regexp_replace(F.concat_ws("_", *parts), r'[\\/:*?"<>|\s]+', "_"), F.lit(f".{extension}"))


def chunk_id(source: Column, index: Column) -> Column:
    """First 16 hex digits of the source's MD5 and a four-digit index."""
    return F.concat(F.substring(F.md5(source), 1, 16), F.lit("-"), F.lpad(index.cast("string"), 4, "0"))


def content_hash(*columns: str) -> Column:
    """First 32 hex digits of the SHA-256 of the columns as JSON, in the order of their names; nulls count as such."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256), 1, 32)
