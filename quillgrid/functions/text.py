"""Text, HTML and number functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the characters that cleaning drops or turns into a space
DROPPED = "\x82\u200b\ue004\ue008\ue009"
SPACES = "\u3000\u00a0\u2002\u2003\ufeff"
# fixed values: what the comparison of markup replaces, in order
NORM_HTML = [("'", '"'), (".", "。"), ("％", "%"), ("“", '"'), ("<br/>", ""), ("pdf-borderless-table", ""), ("pdf-table", "pdf-ocr-table")]
NORM_HTML_TEXT = [("'", '"'), ("<br/>", ""), ("pdf-borderless-table", ""), ("pdf-table", "pdf-ocr-table"), ("％", "%"), ("“", '"'), (".", "。")]
# fixed values: the cells that the empty-box tokens 0 to 10 stand for
EMPTY_BOX_CELLS = ["<td></td>", "<td> </td>", "<td><b> </b></td>", "<td>  </td>", "<td><sup> </sup></td>", "<td><b></b></td>", "<td><i> </i></td>",
                   "<td><b><i></i></b></td>", "<td><b><i> </i></b></td>", "<td><i></i></td>", "<td><b>     </b></td>"]
# fixed values: kinds of comparison and of content with their descriptions
COMPARE_TYPES = {"DIFF": "不同", "SAME": "完全相同", "REMOVE_WIDTH_SAME": "相同（移除宽度信息）", "SAME_LABEL_MISSING_ONE_CHARACTER": "相同（标签缺少一个字符）",
                 "SAME_LABEL_GARBLED_ONE_CHARACTER": "相同（标签一个字符乱码）", "DIFF_TEXT_ORDER": "不同（字序错乱）", "DIFF_TEXT_INCONSISTENT": "不同（内容不一致）",
                 "DIFF_TEXT_PREDICT_LESS_WORDS": "不同（预测内容少字）", "DIFF_TEXT_LABEL_LESS_WORDS": "不同（标签内容少字）", "DIFF_CELL_SPAN_SAME": "相同（cell）",
                 "DIFF_CELL_ROW_SPAN": "不同（cell跨行）", "DIFF_CELL_COL_SPAN": "不同（cell跨列）", "DIFF_CELL_ROW_COL_SPAN": "不同（cell跨行又跨列）",
                 "DIFF_CELL_DIFF_ROW": "不同（cell不同行）", "NONE": "未知"}
CONTENT_TYPES = {"TXT": "文本", "TABLE": "表格", "IMAGE": "图片", "HYPERLINK": "超链接", "NONE": "未知"}
NUMERALS = {"零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10, "百": 100, "千": 1000, "万": 10000}


def clean_sentence(s: Column) -> Column:
    """Without the dropped characters, wide spaces narrow, no line ends at either end."""
    s = F.translate(F.translate(s, DROPPED, ""), "\u3000", " ")
    return F.btrim(s, F.lit("\r\n"))


def clean_sentence_all(s: Column) -> Column:
    s = F.btrim(F.translate(F.translate(s, DROPPED, ""), SPACES, " " * len(SPACES)), F.lit("\r\n"))
    return F.replace(F.replace(s, F.lit("&nbsp"), F.lit(" ")), F.lit("&NBSP"), F.lit(" "))


def remove_space(s: Column) -> Column:
    """Without any white space, that of other scripts included."""
    return F.regexp_replace(s, r"(?U)\s", "")


def clean_table(s: Column) -> Column:
    """Without line ends and head and body tags; the end tag of a body leaves its bracket."""
    return ordered_replace(s, [("\r", ""), ("\n", ""), ("<thead>", ""), ("</thead>", ""), ("<tbody>", ""), ("</tbody", "")])


def ordered_replace(s: Column, pairs) -> Column:
    for a, b in pairs:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def span_of(td: Column, name: str) -> Column:
    """Number of a span attribute, 1 without it."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(td, f'{name}="([0-9]+)', 1), F.lit("")), F.lit("999")).cast("int"), F.lit(1))


def ocr_post_process(s: Column) -> Column:
    """A lone letter o is a zero; in a number of several dots only the last is one."""
    dots = F.length(s) - F.length(F.replace(s, F.lit("."), F.lit("")))
    left, right = F.regexp_extract(s, r"^(.*)\.[^.]*$", 1), F.regexp_extract(s, r"\.([^.]*)$", 1)
    number = s.rlike(r"^[-0-9.,]*$") & (dots > 1)
    return F.when(F.trim(s).rlike("^[oO]$"), "0").when(number, F.concat(F.replace(left, F.lit("."), F.lit(",")), F.lit("."), right)).otherwise(s)


def successive_space(s: Column) -> Column:
    """Three spaces are one, others go."""
    return F.replace(F.replace(F.replace(s, F.lit("   "), F.lit("<space>")), F.lit(" "), F.lit("")), F.lit("<space>"), F.lit(" "))


def one_bold(texts: Column, sep: str) -> Column:
    bare = F.transform(texts, lambda x: F.replace(F.replace(x, F.lit("<b>"), F.lit("")), F.lit("</b>"), F.lit("")))
    return F.when(F.forall(texts, lambda x: x.startswith("<b>")), F.concat(F.lit("<b>"), F.array_join(bare, sep), F.lit("</b>"))).otherwise(F.array_join(texts, sep))


def empty_box_tokens(s: Column) -> Column:
    """Empty-box tokens to cells."""
    return ordered_replace(s, [(f"<eb{i or ''}></eb{i or ''}>", v) for i, v in enumerate(EMPTY_BOX_CELLS)])


def isolated_span(s: Column) -> Column:
    """A span attribute that stands outside its cell goes into it."""
    return F.regexp_replace(s, r'<td></td> ((?:row|col)span="\d+"(?: (?:row|col)span="\d+")?)></b></td>', "<td $1></td>")


def single_bold(s: Column) -> Column:
    """Several bold pieces of a cell become one."""
    return F.regexp_replace(s, "</b>([^<]*)<b>", "$1")


def bold_cells(s: Column) -> Column:
    """Every cell's content in bold, once."""
    bare = F.replace(F.replace(s, F.lit("<b>"), F.lit("")), F.lit("</b>"), F.lit(""))
    return F.regexp_replace(bare, "<td([^>]*)>(.*?)</td>", "<td$1><b>$2</b></td>")


def repair_tail(tokens: Column) -> Column:
    """A list of table tokens that was cut gets its closing tokens."""
    last, before = F.element_at(tokens, -1), F.element_at(tokens, -2)
    return (
        F.when(last != "</tbody>", F.concat(tokens, F.when(last == "</tr>", F.array(F.lit("</tbody>"))).otherwise(F.array(F.lit("</tr>"), F.lit("</tbody>")))))
        .when(before != "</tr>", F.concat(F.slice(tokens, F.lit(1), F.size(tokens) - 1), F.array(F.lit("</tr>"), F.lit("</tbody>")))).otherwise(tokens)
    )


def escape(s: Column) -> Column:
    return ordered_replace(s, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")])


def without_width(s: Column) -> Column:
    """Markup without width and centring attributes."""
    return F.regexp_replace(F.regexp_replace(s, "width=[\"']\\d+%[\"']", ""), "align=[\"']?center[\"']?", "")


def normalised_distance(a: Column, b: Column) -> Column:
    """Edit distance by the longer length."""
    return F.levenshtein(a, b).cast("double") / F.greatest(F.length(a), F.length(b))


def chinese_number(s: Column) -> Column:
    """Value of a numeral, read from its end: units multiply what stands before them, a leading ten counts itself."""
    values = F.create_map(*[x for k, v in NUMERALS.items() for x in (F.lit(k), F.lit(v))])
    digits = F.reverse(F.filter(F.split(s, ""), lambda x: F.length(x) > 0))
    state = F.struct(F.lit(0).alias("total"), F.lit(1).alias("unit"), F.lit(0).alias("i"))
    n = F.size(digits)

    def step(a, ch):
        v = F.element_at(values, ch)
        unit = F.when(v >= 10, F.when(v > a["unit"], v).otherwise(a["unit"] * v)).otherwise(a["unit"])
        lead = (v >= 10) & (a["i"] == n - 1) & (v > a["unit"])
        total = F.when(lead, a["total"] + v).when(v >= 10, a["total"]).otherwise(a["total"] + a["unit"] * v)
        return F.struct(total.cast("int").alias("total"), unit.cast("int").alias("unit"), (a["i"] + 1).alias("i"))

    return F.when(s.rlike("^[0-9]+$"), F.try_to_number(s, F.lit("999999999")).cast("int")).otherwise(F.aggregate(digits, state, step, lambda a: a["total"]))


def half_width(s: Column) -> Column:
    """Full-width forms of printable ASCII to ASCII; the wide space stays."""
    full = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
    return F.translate(s, full, "".join(chr(c) for c in range(0x21, 0x7F)))


def unify_prompt(s: Column) -> Column:
    """Options in trailing brackets sorted and once each."""
    head, options = F.regexp_extract(s, r"^(.*)\[(.*)\]$", 1), F.regexp_extract(s, r"^(.*)\[(.*)\]$", 2)
    return F.concat(head, F.lit("["), F.array_join(F.array_sort(F.array_distinct(F.split(options, ","))), ","), F.lit("]"))


def lookup(key: Column, values: dict) -> Column:
    """Value of a small fixed map, null for other keys."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def language_family(lang: Column) -> Column:
    """Model family of a language code."""
    own = ["ch", "en", "korean", "japan", "chinese_cht", "ta", "te", "ka"]
    latin = "af az bs cs cy da de es et fr ga hr hu id is it ku la lt lv mi ms mt nl no oc pi pl pt ro rs_latin sk sl sq sv sw tl tr uz vi".split()
    return F.when(lang.isin(*own), lang).when(lang.isin(*latin), "latin").otherwise("other")


def duration(seconds: Column) -> Column:
    """Milliseconds below a second, else seconds, with three places."""
    return F.when(seconds < 1, F.format_string("%.3f ms", seconds * 1000)).otherwise(F.format_string("%.3f s", seconds))


def timestamp_of(s: Column) -> Column:
    """Seconds of a date or a time written out, 0 for a blank."""
    long = F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss"))
    day = F.try_to_timestamp(s, F.lit("yyyy-MM-dd"))
    return F.when(F.trim(s) == "", F.lit(0)).when(F.length(s) >= 19, F.unix_timestamp(long)).otherwise(F.unix_timestamp(day)).cast("long")


def css(style: Column) -> Column:
    """Map of the declarations of a style."""
    m = F.str_to_map(style, F.lit(";"), F.lit(":"))
    return F.transform_values(F.transform_keys(m, lambda k, v: F.trim(k)), lambda k, v: F.trim(v))


def cell_type(classes: Column) -> Column:
    """Kind of a spreadsheet cell from its classes; a formula comes first."""
    own = F.split(classes, " ")
    has = lambda x: F.array_contains(own, f"TYPE_{x}")
    return F.when(has("FORMULA"), "FORMULA").when(has("CURRENCY") | has("INTEGER") | has("PERCENTAGE"), "NUMERIC").otherwise("STRING")


def number_format(classes: Column) -> Column:
    own = F.split(classes, " ")
    has = lambda x: F.array_contains(own, f"TYPE_{x}")
    return F.when(has("CURRENCY"), "$#,##0.00").when(has("INTEGER"), "#,##0").when(has("PERCENTAGE"), "0.0%").otherwise("General")
