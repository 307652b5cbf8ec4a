from __future__ import annotations

from graphloom.llm import spam

DOCS = "doc_id long, text string"
PROSE = "The registry keeps one lease for every open channel and waits until the writer has been closed. Note that older releases ignored this setting, which is why the default was changed. "

SPAM = [
    "top clock, cheap loader, download entry, pro theme, best image, free vault, top clock, cheap loader, key job, mac index",
    "buy queue cheap queue best loader free vault online market price image trial report full theme key index pro matrix",
    "vs metric 2025\nonline palette\neasy report official\nfree vault\nbuy theme\nvs metric 2025\nonline palette\nfree vault\n" * 2,
    "Looking for pro cursor? Our pro cursor beats every pro cursor. Why pro cursor? Because pro cursor, pro cursor and best theme. pro cursor pro cursor! Get pro cursor with pro cursor today.",
    "\n".join(f"- https://a{i}.example/x/{i}.html" for i in range(12)),
    "\n".join(f"best theme >> http://b{i}.example/p?q={i}\n[premium]\n#cheap" for i in range(6)),
    "\n".join(f"* [top theme](https://c{i}.example/y)" for i in range(8)),
    "#fastQueue #bestTheme #vault #freeIndex #queue #cheapLoader #theme #vault",
    "\n".join(f"Best Loader Pro | SKU {100 + i} | red | plugin | 9{i % 10}.99" for i in range(8)),
    "最新版 グラフ, 人気 索引, 無料 接続, おすすめ 関数, 通販 履歴, 激安 要求, 比較 頂点, 最安値 拡張機能, ランキング 構文解析器, ダウンロード 依存関係",
    PROSE + "\n\n" + "free vault, cheap loader, top clock, key job, " * 20,
]

HONEST = [
    "", "Short note.", PROSE * 4, "\n".join(f"- [empty canvas](https://a.example/{i}) — {PROSE}" for i in range(4)),
    "\n".join(f"2025-06-16T13:46:2{i % 10}Z WARN response.filterQuery retry id={i} ms=517" for i in range(20)),
    "# generated\nversion = 2\n\n[target.filter]\nversion = \"1.2\"\nchecksum = \"6e56\"\noptional = true\n" * 4,
    "| option | type | meaning |\n|---|---|---|\n" + "\n".join(f"| `a.b{i}` | int | {PROSE} |" for i in range(4)),
    "\n".join(f"Hidden parser {i}: {PROSE}" for i in range(5)), "# Changelog\n\n## 1.2.3 (2024-01-01)\n\n" + "\n".join(f"- Fixed: {PROSE} (#{i})" for i in range(5)),
    "def load(a):\n    return a\n\n\nclass Store:\n    x = 1\n    def go(self):\n        for i in self.x:\n            print(i)\n" * 3, "エラーが出た場合は、まずファイルの内容を確認してください。ルーターと接続の順序は保証されません。" * 4,
    "En cas d'échec, le lecteur ignore le fichier et continue. En cas d'échec, le lecteur ignore le paquet et continue. Par défaut, la clé reste valable pendant 8 minutes.",
    PROSE * 3 + "\n\nTags: top clock, cheap loader, key job, free vault",
]


def share(text):
    p = spam.profile(text)
    return (p["repeated"] + p["listed"]) / max(1, p["all"])


def test_spam_and_honest_pages():
    for text in SPAM:
        assert share(text) > 0.5, text
    for text in HONEST:
        assert share(text) <= 0.5, text


def test_the_measurements_decide():
    for text in SPAM:
        off = spam.profile(text, repetition=False, lists=False)
        assert off["repeated"] + off["listed"] == 0, text
    regular = spam.profile("\n".join(f"Best Loader Pro | SKU {100 + i} | red | plugin | 9{i % 10}.99" for i in range(8)), lists=False)
    assert regular["repeated"] > 0.5 * regular["all"] and regular["regularity"] >= 1
    links = spam.profile("\n".join(f"- https://{a}.example/{b}" for a, b in zip("alpha brick cedar delta ember frost grove haven".split(), "index jolly knack lemon mango north oasis piano".split())))
    assert links["listed"] == links["all"] and links["distinctness"] == 1


def test_signals():
    codes = spam._coded("a b c d".split() * 10)
    assert spam.regular_share(codes) == 1 and int(spam.autocorrelation(codes).argmax()) == 3
    assert spam.regular_share(spam._coded(list("abcdefgh"))) == 0
    assert spam.run_signals(["a"]) == (0, 0, 0)


def test_operator(frame):
    rows = [(i, t) for i, t in enumerate(SPAM)] + [(100 + i, t) for i, t in enumerate(HONEST)] + [(200, None), (0, SPAM[0]), (300, PROSE * 5000), (301, SPAM[0].replace(",", "\r\n") * 300), (302, "#a #b #c #d")]
    got = sorted(r.doc_id for r in spam.spam_pages(frame(rows, DOCS)).collect())
    assert got == sorted([0, *range(len(SPAM)), 301])
    profiles = spam.page_profiles(frame(rows, DOCS))
    assert profiles.count() == len(rows) and profiles.where("doc_id = 200").first().spam_share == 0.0
    assert spam.spam_pages(frame([], DOCS)).count() == 0
