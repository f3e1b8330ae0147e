import random

from limnos.llm.extraction import blocks, classify, extract, main_text

LINE = "The cat is on the mat and it was not in the house of the man who had been there. "


def page(body):
    return f"<html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_regions_outside_the_text_go():
    out = main_text(
        page(
            '<header><h1>Site</h1></header><nav><a href="/">Home</a></nav><div class="cookie-notice">We use the cookies of the site and it is so.</div>'
            f'<article><h1>A &amp; B</h1><p>{LINE * 4}</p><script>if (a < b) "</p>"</script><p>short  \n one<br>more</p>'
            '<div class="ad">buy</div><form><p>mail</p></form></article>'
            f'<aside><p>{LINE * 4}</p></aside><section id="comments"><p>{LINE * 4}</p></section><footer>&copy; x</footer>'
        )
    )
    assert out == f"A & B\n{(LINE * 4).strip()}\nshort one more"


def test_unmarked_pages_are_judged_by_words_links_and_neighbours():
    body = f"<div><a href=x>one</a> <a href=y>two</a> <a href=z>three</a></div><h2>Heading</h2><div>{LINE * 4}</div><div>Short.</div><div>{LINE * 4}</div><div>{'zzz qqq ' * 40}</div><div>tail</div>"
    assert main_text(page(body)) == "\n".join(["Heading", (LINE * 4).strip(), "Short.", (LINE * 4).strip()])


def test_hidden_only_as_an_attribute_or_a_style():
    kept = f"<article><p>{LINE * 3}</p></article>"
    seen = (
        'class="overflow-hidden"', "class='hidden-xs visually hidden'", "class=hidden", 'style="overflow:hidden"', 'style="overflow: hidden; color: red"', 'data-x="hidden"', "data-hidden", 'data-style="display:none"',
        'title="a hidden place"', 'title="display:none"', 'style="--display:none"', 'style="display:none;display:block"', 'hidden="false"', 'aria-hidden="false"', 'title="aria-hidden=true"', 'id=x/hidden',
    )
    for attributes in seen:
        assert main_text(page(f"<div {attributes}>{kept}</div>")) == (LINE * 3).strip(), attributes
    unseen = ("hidden", "HIDDEN=''", 'class="a"hidden', 'id="x" hidden=hidden', 'hidden="until-found"', 'aria-hidden="true"', "aria-hidden=true", 'style="display:none"', "style='color:red; Display : NONE !important'", 'style="display:none;overflow:hidden"', "style=display:none", 'style="display:none!important;display:block"', 'style="/* x */ display:none"')
    for attributes in unseen:
        assert main_text(page(f"<div {attributes}>{kept}</div>")) == "", attributes


def test_names_that_wrap_a_page_do_not_empty_it():
    kept = f"<h1>Title</h1><p>{LINE * 4}</p><p>short</p>"
    want = f"Title\n{(LINE * 4).strip()}\nshort"
    aside = f'<div class="sidebar"><p>{LINE}</p></div><form><p>your mail</p></form><div class="main-nav"><p>{LINE}</p></div>'
    for wrapped in (
        f'<div class="layout has-sidebar"><article>{kept}</article>{aside}</div>', f'<div class="no-comments"><article>{kept}</article>{aside}</div>',
        f'<div class="ad-free page"><article>{kept}</article></div>{aside}', f'<main class="with-nav">{kept}{aside}</main>', f'<article class="post share-enabled">{kept}{aside}</article>',
        f'<form id="aspnetForm"><article>{kept}</article>{aside}</form>', f'<div class="widget"><main>{kept}</main></div>', f'<fieldset class="toolbar"><article>{kept}</article></fieldset>{aside}',
        f'<article class="main-content-nav">{kept}{aside}</article>',
    ):
        assert main_text(page(wrapped)) == want, wrapped


def test_comments_and_hidden_parts_stay_out_whatever_they_hold():
    kept = f"<article><p>{LINE * 3}</p></article>"
    many = f"<article><p>{LINE * 9}</p></article>" * 3
    for out in (f'<section id="comments">{many}</section>', f'<ol class="comment-list">{many}</ol>', f'<article class="comment-body">{LINE * 9}</article>', f"<div hidden>{many}</div>", f"<aside>{many}</aside>", f'<div class="related-posts"><p>{LINE * 2}</p></div>'):
        assert main_text(page(kept + out)) == (LINE * 3).strip(), out


RUSSIAN = "Река течёт через весь город, и вдоль её берегов стоят старые дома, в которых давно никто не живёт. "


def test_languages_without_stop_words_go_by_length_and_links():
    menu = "<div><a href=x>Главная страница нашего большого сайта</a> <a href=y>Новости и события города</a> <a href=z>Связь</a></div>"
    body = f"{menu}<div>{RUSSIAN * 3}</div><div>{RUSSIAN}</div><div>{RUSSIAN * 3}</div>"
    assert main_text(page(body)) == "\n".join([(RUSSIAN * 3).strip(), RUSSIAN.strip(), (RUSSIAN * 3).strip()])


def first_rules(kinds):
    """The second pass by the definition, over first labels alone: an independent statement of it."""
    out = []
    for i, k in enumerate(kinds):
        before, after = kinds[:i][::-1], kinds[i + 1 :]
        decided = [next((x for x in side if x in ("good", "bad")), "bad") for side in (before, after)]
        closest = [next((x for x in side if x != "short"), "bad") for side in (before, after)]
        if k in ("good", "bad"):
            out.append(k)
        elif decided[0] == decided[1]:
            out.append(decided[0])
        elif k == "near":
            out.append("good")
        else:
            out.append("good" if "near" in closest and "bad" not in closest else "bad")
    return out


def test_second_pass_equals_its_definition():
    rng = random.Random(6)
    texts = {"good": LINE * 4, "near": LINE, "bad": "zzz qqq " * 40, "short": "one two"}
    for _ in range(300):
        kinds = [rng.choice(list(texts)) for _ in range(rng.randrange(1, 9))] + ["good"]
        found = classify(blocks(page("".join(f"<div>{texts[k]}</div>" for k in kinds))))
        assert [b.label for b in found] == first_rules(kinds), kinds


def test_broken_markup():
    assert main_text(f"<article><p><b>{LINE * 3}<br><p>next <i>one</p></b>") == f"{(LINE * 3).strip()}\nnext one"
    assert main_text("<article>a<!-- b --><script>c") == "a"
    assert main_text("<article>1 < 2 &lt; 3 &#x26; &nope;</article>") == "1 < 2 < 3 & &nope;"
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == ""
    assert len(blocks("<div>" * 50_000 + "x" + "</b>" * 50_000)) == 1


def test_table(spark):
    rows = [(1, "u", f"<article><p>{LINE * 3}é</p></article>", "k", "t"), (2, None, None, None, None), (None, "u", "", "k", "t"), (1, "u", f"<article><p>{LINE * 3}é</p></article>", "k", "t")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, key string, text string")).collect()
    assert sorted((r["key"] or 0, r["n_chars"]) for r in got) == sorted([(1, len(LINE * 3) + 1), (2, 0), (0, 0), (1, len(LINE * 3) + 1)])
    assert all(len(r["text"]) == r["n_chars"] for r in got)
