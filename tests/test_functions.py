"""Unit tables for text, URL, price and image functions."""

import math
import re

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import image as I, price as P, text as X, url as U


def test_clean_text_covers_unicode_spaces(evaluate):
    got = evaluate(["a  b", "　x　", " a  b ", "plain text", None, "t\tu\x1c\nv"], X.clean_text("a"))
    assert got == ["a b", "x", "a b", "plain text", "", "t u v"]
    assert evaluate(["a  b", "x "], X.clean_text(F.concat("a", F.lit(" ")))) == ["a b", "x"]


def test_normalize(evaluate):
    texts = ["R&D AB-123", "Café Crème", "  ", "场效应", None]
    assert evaluate(texts, X.normalize_search("a")) == ["r and d ab 123", "caf cr me", "", "", ""]
    assert evaluate(texts, X.normalize_fold("a")) == ["r and d ab 123", "cafe creme", "", "", ""]
    once = evaluate(texts, X.normalize_search("a"))
    assert evaluate(once, X.normalize_search("a")) == once


def test_tokens_and_parts(evaluate):
    assert evaluate(["a b a", ""], X.tokens("a"), X.token_seq("a")) == [(["a", "b"], ["a", "b", "a"]), ([], [])]
    texts = ["irf540n", "ab12", "lm 317 t", "ab1 converter", "ab1 cd2 ef3 g", "12345", "x" * 40 + "1"]
    assert evaluate(texts, X.looks_like_part("a")) == [True, False, False, False, False, False, False]
    assert evaluate(["ab12 34x"], X.looks_like_part("a")) == [True]


def test_names(evaluate):
    names = ["agent", "Agent Shop 2024-01-02T03", "", "Shop", "Lumen Works"]
    assert evaluate(names, X.is_generic_name("a")) == [True, True, True, True, False]
    assert evaluate(['a/b:  c. ', "", "x" * 100], X.safe_name("a")) == ["a_b_ c", "shop", "x" * 96]
    assert evaluate(["_a b//c_", ""], X.safe_name("a", "saved_page")) == ["a_b_c", "item"]
    assert evaluate(["_a b_"], X.safe_name("a", "live_page")) == ["_a_b_"]


def test_lists_and_lines(evaluate):
    assert evaluate([(["b", " A", "a", "", "b "],)], X.string_list("a")) == [["A", "a", "b"]]
    assert evaluate(["1. http://a\r\n 2) http://b\n\n"], X.clean_url_lines("a")) == [["http://a", "http://b"]]
    assert evaluate(["", "nope", "2024-01-02T03:04:05"], X.display_time("a")) == ["unknown time", "nope", "2024-01-02 03:04:05"]


def test_listing_id(evaluate):
    import hashlib

    want = hashlib.sha1("s|f|1|2|t|a|b|c".encode()).hexdigest()[:16]
    assert evaluate(["s"], X.listing_id("a", *map(F.lit, ["f", "1", "2", "t", "a", "b", "c"]))) == [want]


def test_unquote(evaluate):
    texts = ["a%20b", "a+b", "%zz%41", "100%", "%E4%BD%A0", "plain"]
    assert evaluate(texts, U.unquote("a")) == ["a b", "a+b", "%zzA", "100%", "你", "plain"]
    deep = "x%2525252525252541"
    assert evaluate([deep], U.decode_repeatedly("a"), U.decode_repeatedly("a", None)) == [("x%252541", "xA")]


def test_offer_ids(evaluate):
    urls = ["http://h/offer/12.html", "http://h/x?id=34", "http://h/item-1688-56", "http://h/a?offerId=78", "http://h"]
    assert evaluate(urls, U.offer_id("a")) == ["12", "34", "", "78", ""]
    assert evaluate(urls, U.offer_id("a", profile="queue")) == ["12", "34", "56", "78", ""]
    assert evaluate(urls, U.offer_id("a", profile="saved_page")) == ["12", "", "", "78", ""]
    assert evaluate(urls, U.offer_id("a", profile="live_page")) == ["12", "34", "", "78", ""]
    assert evaluate([("", "http://h/offer/9.html")], U.offer_id("a", "b")) == ["9"]


def test_shop_key(evaluate):
    urls = ["http://s/q?shopid=5&b=1", "http://s/#/x?shopid=6", "http://s/shops/ab?x=1", "http://s/#/shops/cd?z=1",
            "http://s/?sellerId=7", "HTTP://S/p?b=2&a=1&c=#f", "http://s/?shopid=&sellerId=8", ""]
    assert evaluate(urls, U.shop_key("a")) == [
        "shopid:5", "shopid:6", "shops:ab", "shops:cd", "sellerid:7", "http|s|/p|a=1&b=2|f", "sellerid:8", ""]


def test_url_kinds(evaluate):
    urls = ["http://s/shops/1", "http://s/?ShopID=", "http://s/products?x=1", "http://d/?u=1#/p?productLink=http%3A%2F%2Fx", "http://s/"]
    assert evaluate(urls, U.is_store_url("a"), U.is_listing_url("a")) == [
        (True, False), (True, False), (False, True), (False, True), (False, False)]
    assert evaluate(["ftp://a", "https://a/b", "https:///b", "x"], U.valid_url("a")) == [False, True, False, False]
    rows = [("http://a/login", "", 0), ("http://a/", "Sign in or register", 0), ("http://a/", "sign in", 0), ("http://a/", "Sign in, register", 3)]
    assert evaluate(rows, U.needs_login("a", "b", "c")) == [True, True, False, False]


def test_agent_urls(evaluate):
    wrapped = "https://www.agent.example.com/products?productLink=https%253A%252F%252Fd%252Fa%2520b"
    assert evaluate(["https://d/a b", ""], U.agent_url("a")) == [wrapped, ""]
    assert evaluate([wrapped], U.product_link("a")) == ["https://d/a b"]
    assert evaluate(["https://detail.1688.com/offer/9.html"], U.product_link(U.normalize_url("a"))) == ["https://detail.1688.com/offer/9.html"]
    assert evaluate(["https://item.taobao.com/item.htm?id=4"], U.product_link(U.normalize_url("a"))) == ["https://item.taobao.com/item.htm?id=4"]


def test_images(evaluate):
    urls = ["data:image/PNG;base64,xx", "http://h/a.JPEG?x=1", "http://h/a", "", "data:text/x,1"]
    assert evaluate(urls, U.image_extension("a")) == ["png", "jpeg", "jpg", "bin", "bin"]
    rows = [("p.webp", "1", "t", 1), ("pic", "1", "t", 2), ("", "", "", 3)]
    assert evaluate(rows, U.saved_image_file("a", "b", "c", "d")) == ["p.webp", "pic.jpg", "item-3.jpg"]
    assert evaluate([("", "images/a b/c.jpg"), ("http://x", "y"), ("", "")], U.image_link("a", "b")) == ["/files/images/a%20b/c.jpg", "http://x", ""]
    rows = [("", "Lumen - Agent mall", "http://x/y"), ("", "", "http://x/a-b_c/"), ("Head", "t", "u")]
    assert evaluate(rows, U.shop_name_from_page("a", "b", "c")) == ["Lumen", "a b c", "Head"]


PRICES = ["US$1,234.50", "CA$10", "C$ 3", "￥12", "¥0.5", "RMB 8", "$9", "7-9", "free", "", "-2.5", "cad 4"]


def test_numbers_and_markers(evaluate):
    assert evaluate(PRICES, P.coerce_number("a")) == [1234.5, 10, 3, 12, 0.5, 8, 9, 7, None, None, -2.5, 4]
    assert evaluate(PRICES, P.source_currency("a")) == ["usd", "cad", "cad", "cny", "cny", "cny", "usd", "cny", "cny", "", "cny", "cad"]
    assert evaluate([("5", "USD"), ("￥5", "usd"), ("", "cad"), ("", "x")], P.source_currency("a", "b")) == ["usd", "cny", "cad", ""]


def test_convert(evaluate):
    rates = P.Rates(1.37, 0.19)
    codes = [(10.0, s, t) for s in P.CURRENCIES for t in P.CURRENCIES]
    out = evaluate(codes, P.convert("a", "b", "c", rates))
    back = evaluate([(v, t, s) for v, (_, s, t) in zip(out, codes)], P.convert("a", "b", "c", rates))
    assert all(math.isclose(b, 10.0, abs_tol=1e-9) for b in back)
    assert evaluate([(1.0, "usd", "usd"), (1.0, "usd", "cny"), (1.0, "eur", "cny")], P.convert("a", "b", "c", P.Rates(0, 0.19))) == [1.0, None, None]
    assert evaluate([(float("inf"), "usd", "usd")], P.convert("a", "b", "c", rates)) == [None]


def test_price_texts(evaluate):
    assert evaluate([(1.0, "usd"), (1.23456, "cad"), (9.055, "cny"), (1000.5, "")], P.format_price("a", "b")) == ["US$1.00", "CA$1.2346", "￥9.055", "￥1000.50"]
    assert evaluate([0.005, 1234.5, -2.0, 0.0], P.display_amount("a", "usd")) == ["$0.005", "$1,234.50", "-$2.00", "$0.00"]
    got = evaluate(["9-2", "3..4.5", "7", "x"], P.price_range("a"))
    assert [(r["min_price"], r["max_price"]) for r in got] == [(2, 9), (3, 4.5), (7, None), (None, None)]
    # Known fault: bare API numbers are hundredths.
    assert evaluate([("", "15000"), ("US$3", "9"), ("", "free"), (None, "")], P.api_price_text("a", "b")) == ["￥150.00", "US$3.00", "free", ""]
    assert evaluate(["￥150.00", "about 9 each", "none", "9.055"], P.rescale_text("a")) == ["￥1.50", "about 0.09 each", "none", "0.09"]


def test_price_near(evaluate):
    rows = [("Product link > ¥ 5.5 Foo ￥9", "Foo"), ("x Foo bar ￥ 12", "foo"), ("￥3 Foo", "Foo"), ("￥3", "")]
    assert evaluate(rows, P.price_near(F.col("a"), F.col("b"))) == ["￥5.5", "￥12", "", ""]


def test_signatures(evaluate):
    rising, falling = [float(i % 9) for i in range(72)], [float(9 - i % 9) for i in range(72)]
    assert evaluate([(rising,), (falling,)], I.dhash("a")) == [0, -1]
    one = [0.0] * 72
    one[0] = 1.0
    one[10] = 1.0  # second row, second column: brighter than its right neighbour, darker than its left one is not
    assert evaluate([(one,)], I.dhash("a")) == [1 | 1 << 9]
    hist = evaluate([([0.0, 15.9, 16.0, 255.0],)], I.luma_histogram("a"))[0]
    assert (hist[0], hist[1], hist[15], sum(hist)) == (0.5, 0.25, 0.25, 1.0)
    h = F.array(F.lit(0.5), F.lit(0.5))
    same = I.signature_similarity(F.lit(7), h, F.lit(1.0), F.lit(7), h, F.lit(1.0))
    assert evaluate([1], same)[0] == pytest.approx(1.0)
    norm = evaluate([([3.0, 4.0],), ([0.0, 0.0],)], I.l2_normalize("a"))
    assert norm == [[0.6, 0.8], [0.0, 0.0]]
    assert evaluate(["data:image/png;base64,aGk=", "aGk=", ""], I.decode_payload("a")) == [bytearray(b"hi"), bytearray(b"hi"), None]


def test_natural_key_sorts_numbers_by_value(evaluate):
    texts = ["part 10", "part 9", "part 009b", "part 1000000000000000000000000", "part", "part 0", "", "12 a", "2 a", "a2b10", "a2b9"]
    keys = dict(zip(texts, evaluate(texts, X.natural_key("a")), strict=True))

    def natural(t):
        return [(0, int(r), "") if r[0].isdigit() else (1, 0, r) for r in re.findall("[0-9]+|[^0-9]+", t)]

    assert sorted(texts, key=keys.get) == sorted(texts, key=natural)
