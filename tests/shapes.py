"""Line tables of an invented loom handbook: pages of 612 x 792, line n of a page at y = 90 + 14 n."""
from citeline.operators.lines import with_text

LINES = (
    "doc_id string, page int, idx int, x0 double, y0 double, x1 double, y1 double, page_w double, page_h double,"
    " spans array<struct<text:string,font:string,size:double>>"
)
TEXT, HEAVY, DISPLAY = "Lora", "Lora-Bold", "DigitFont-Regular"


def part(text, font=TEXT, size=9.5):
    return (text, font, size)


def title(text, size=18.0):
    return [part(text, HEAVY, size)]


def alarm(name, code, font=DISPLAY, size=16.0):
    return [part(f"[{name}] ", HEAVY, size), part(code, font, size)]


def placed(doc, page, idx, y, content):
    parts = [part(content)] if isinstance(content, str) else content
    return (doc, page, idx, 72.0, float(y), 500.0, y + 11.0, 612.0, 792.0, parts)


def page_rows(pages, doc="loom"):
    return [placed(doc, page, n, 90 + 14 * n, content) for page, contents in pages.items() for n, content in enumerate(contents)]


def handbook(spark, pages, doc="loom"):
    return with_text(spark.createDataFrame(page_rows(pages, doc), LINES))
