from rayframe.llm.html import main_text


def test_article_only():
    page = '<html><head><title>t</title><script>var t="</p>";</script></head><body><nav><a href="/x">x</a></nav><!-- ad --><div class="ad">buy\nthis</div><article><h1>A &amp; b</h1><p><b>One  two.<br><p>Three.</p></article><footer>&copy; me</footer>'
    assert main_text(page) == "A & b\nOne two.\nThree."


def test_empty():
    assert main_text(None) == main_text("") == ""


def test_names_are_whole():
    for page in ('<body class="has-sidebar"><article><p>text</article>', '<body class="menu"><article><div class="content no-comments"><p>text</div></article>', '<article class="post share"><p>text</article>', '<article><p data-class="ad">text</article>'):
        assert main_text(page) == "text"
    for name in ("ad", "x ads", "cookie-banner", "comments"):
        assert main_text(f'<article><div class="{name}"><p>no</div><p>text</article>') == "text"


def test_omitted_end_tags():
    cases = {
        '<ul><li class="menu-item">a<li class=b>c</ul><p>t': "a\nc\nt",
        "<ul><li class='menu'>a<li>b</ul><p>t": "b\nt",
        "<p class='notice'>x<p>text": "text",
        "<ul><li class=menu>a<ul><li>i<li>j</ul>k<li>b</ul><p>t": "b\nt",
        "<table><tr><td class=ad>x<td>y<tr class=ad><td>z<tr><td>w</table>t": "y\nw\nt",
        "<div class=ad><p>q<p>r<br><img src=x></div>t": "t",
        "<section><div class=ad>q</section>t": "t",
        "<embed class=ad>t": "t",
    }
    for part, text in cases.items():
        assert main_text(f"<html><body><article>{part}</article>") == text


def test_without_article_in_other_languages():
    texts = {
        "ru": "Вчера вечером жители небольшого города собрались на площади, чтобы обсудить новые правила движения транспорта и работу городских служб в зимнее время года.",
        "pl": "Wczoraj wieczorem mieszkańcy niewielkiego miasta zebrali się na rynku, aby omówić nowe zasady ruchu oraz pracę służb miejskich podczas zimowych miesięcy roku.",
        "tr": "Dün akşam küçük kasabanın sakinleri yeni trafik kurallarını ve kış aylarında belediye hizmetlerinin nasıl çalışacağını görüşmek üzere meydanda bir araya geldiler.",
        "ar": "اجتمع سكان المدينة الصغيرة مساء أمس في الساحة لمناقشة قواعد المرور الجديدة وعمل الخدمات البلدية خلال أشهر الشتاء الباردة من هذه السنة وما يليها من أعوام قادمة.",
        "zh": "昨天晚上，小城的居民聚集在广场上，讨论新的交通规则以及冬季市政服务的工作安排，会议持续了三个多小时，许多人提出了自己的意见和建议。",
        "ja": "昨日の夜、小さな町の住民は広場に集まり、新しい交通規則と冬の間の市のサービスについて話し合い、多くの人が自分の意見や提案を述べました。",
        "en": "The people of the small town came to the square in the evening to speak of the new rules of the road and of the work that is to be done by the town in winter.",
    }
    for lang, text in texts.items():
        links = "".join(f"<li><a href='/{i}'>{text[:30]}</a></li>" for i in range(8))
        page = f"<html><body><ul>{links}</ul><div><p>{text}</p><p>{text}</p></div><div><a href='/'>{text}</a></div></body></html>"
        assert main_text(page) == f"{text}\n{text}", lang


def test_linked_paragraphs_quotes_and_open_elements():
    linked = '<article><p><a href="x">A linked paragraph of the article</a></p><p>Text.</p></article>'
    assert main_text(linked) == "A linked paragraph of the article\nText."
    assert main_text('<article><p title="a > b">One</p><p title="open>Two</p></article>').startswith("One")
    assert main_text("<article><p>Before.</p><form action=x><p>After.</p><p>End.</p></article>") == "Before.\nAfter.\nEnd."
    assert main_text("<article><p>Before.</p><form action=x><p>Name</p></form><p>End.</p></article>") == "Before.\nEnd."


def test_extract_odd_rows(spark):
    from rayframe.llm.html import extract

    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (2, None, "", "y"), (None, "v", "<article><p>T" + "e" * 300000 + "</p></article>", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.n_chars) for r in extract(pages).collect()), key=str)
    assert got == [(1, 0), (1, 0), (2, 0), (None, 300001)]
    assert extract(pages.where("false")).count() == 0
