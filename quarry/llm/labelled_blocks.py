"""The small labelled table that the block classifier is trained on: invented pages, main-text elements marked with y="1"."""

from __future__ import annotations

import random

_SYLLABLES = "ka lo mi ren tas vo du shel por ing an ter um bri so fel gat nor wi ex".split()


def _words(rng: random.Random, n: int) -> str:
    out = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    for i in range(7, n, 9):
        out[i] += rng.choice([".", ",", ".", ";"])
    return " ".join(out).capitalize() + "."


#: @n is n words, ~n about n words. In turn: semantic pages, pages of divs with telling names, pages of plain divs and tables.
SKELETONS = [
    """<body><nav><ul><li><a href=x>@1</a></li><li><a href=x>@2</a></li><li><a href=x>@1</a></li></ul></nav><div class="ad">~8</div><article><h1 y=1>~7</h1><p y=1>~40<p y=1>~3<p y=1>~60</article><footer>&copy; @3</footer></body>""",
    """<body><header><h1><a href=/>@2</a></h1><p>@6</p></header><nav><a href=x>@1</a> <a href=x>@1</a></nav><main><article><h2 y=1>@5</h2><p y=1>~30</p><p y=1>@2</p><aside><h3>@2</h3><ul><li><a href=x>@4</a><li><a href=x>@5</a></ul></aside><p y=1>~25 <a href=x>@2</a> ~9</p><ul><li y=1>@6<li y=1>@3</ul></article></main><footer><p>@9</p><a href=x>@1</a></footer></body>""",
    """<body><div class="cookie-notice"><p>~25</p><button>@1</button></div><div id=header class=masthead>@3</div><div class="main-menu"><a href=x>@1</a><a href=x>@2</a></div><div class="content"><h1 y=1>@6</h1><p y=1>~50</p><p y=1>~4</p><blockquote y=1>~20</blockquote><div class="ads">~12</div><p y=1>~35</p></div><div class="sidebar"><h3>@2</h3><p>~30</p></div><div class="comments"><h3>@2</h3><div class=comment><p>~30</p></div><div class=comment><p>~8</p></div></div><div class="footer">@12</div></body>""",
    """<body><div><a href=x>@1</a> | <a href=x>@1</a> | <a href=x>@2</a></div><div><h1 y=1>@6</h1><p y=1>~70</p><p y=1>~50</p><p y=1>@4</p><p y=1>~45</p></div><div><a href=x>@4</a></div><div><a href=x>@5</a></div><div>@5</div></body>""",
    """<body><article class="post"><header><h1 y=1>@5</h1></header><div class="entry-content"><p y=1>~20</p><h2 y=1>@3</h2><p y=1>~30</p><pre y=1>@7</pre></div><div class="share">@2 <a href=x>@1</a> <a href=x>@1</a></div><section id="comments"><h2>@2</h2><p>~40</p><form><label>@2</label><textarea>@2</textarea><button>@1</button></form></section></article><aside class="related"><p>~22</p></aside></body>""",
    """<body><div role=banner>@4</div><div role=navigation><a href=x>@1</a><a href=x>@1</a></div><div role=main><h1 y=1>@4</h1><p y=1>@1</p><p y=1>~28</p><table><tr><td y=1>@2<td y=1>@3<tr><td y=1>@1<td y=1>@4</table><div class="newsletter-signup"><p>~14</p><form><input><button>@1</button></form></div></div><div role=contentinfo>~12</div></body>""",
    """<body><header>@5</header><form action=s><label>@1</label><select><option>@1<option>@1</select></form><article><p y=1>~3</p><p y=1>~80</p><div class="promo sponsored"><p>~30</p></div><footer>@6</footer></article><div id="disqus_thread" class="reader-comments"><p>~50</p><p>~25</p></div></body>""",
    """<body><main><h1 y=1>@3</h1><section y=1><p y=1>~20</p><p y=1>@2</p></section><div hidden><p>~30</p></div><div style="display:none">~20</div><nav><ol><li><a href=x>@2</a></ol></nav><p y=1>~15 <a href=x>@3</a></p><p y=1><a href=x>@6</a></p></main><aside>~25</aside><footer>~30</footer></body>""",
    """<body><div class="notice alert">~9</div><div class="breadcrumbs"><a href=x>@1</a> <a href=x>@1</a></div><div class="article-body"><h1 y=1>@8</h1><p y=1>~33</p><p y=1>~5</p><p y=1>~41</p></div><div class="popular widget"><ul><li>@5<li>@6</ul></div><div class=copyright>@6</div></body>""",
    """<body><table><tr><td><a href=x>@1</a><br><a href=x>@2</a><br><a href=x>@1</a></td><td><h1 y=1>@5</h1><p y=1>~60</p><p y=1>~44</p><p y=1>~38</p></td></tr></table><p>@4 <a href=x>@2</a></p></body>""",
    """<body><article><h1 y=1>@2</h1><p y=1>@1</p><p y=1>@1</p><p y=1>@2</p></article><footer>~40 ~40</footer><aside>~90</aside><nav>~20</nav><div class=ad>~60</div></body>""",
    """<body><div class="top-notice" role=alert>~40</div><div class="post"><p y=1>@2</p><p y=1>~6</p><figure><figcaption y=1>@5</figcaption></figure><p y=1>~55</p></div><div class="advertisement">~50</div><div class="respond"><p>~12</p><p>@3</p></div><div id=footer>~25</div></body>""",
    """<body><header class=site><nav><a href=x>@1</a></nav><p>~30</p></header><main><article><header><h1 y=1>@4</h1></header><p y=1>~18</p><section class=comments><article class=comment><p>~30</p><p>@2</p></article></section></article></main></body>""",
    """<body><article><h1 y=1>@5</h1><p y=1>~30</p><p y=1>@2</p><p y=1>~12 <a href=x>@3</a></p></article></body>""",
    """<body><nav><a href=x>@1</a></nav><article><p y=1>~8</p><p y=1><a href=x>@4</a></p><p y=1><a href=x>@9</a> @2</p><p y=1>@3""",
    """<body><h1 y=1>@4</h1><p y=1>~60</p><p y=1>~40</p><p y=1>@6</p><p y=1>~50</p></body>""",
    """<body><div>@2</div><div>~14</div><article><p y=1>~9</p><p y=1><a href=x>@4</a></p><p y=1><a href=x>@1</a></p><p y=1>@1</p></article><div>~12</div><div>~40</div></body>""",
    """<body><p>~30</p><main><p y=1>@1</p><ul><li y=1><a href=x>@3</a><li y=1><a href=x>@2</a></ul><p y=1>@5</p></main><div>@5</div><p>~35</p></body>""",
    """<body><div class=story><h1 y=1>@3</h1><p y=1>@2</p><p y=1><a href=x>@5</a></p><p y=1>~20</p></div></body>""",
    """<body><section class=article-content><p y=1>~22</p><p y=1>@1</p></section><div>~25</div></body>""",
    """<body class="has-sidebar menu-open"><div class="menu"><a href=x>@1</a><a href=x>@2</a></div><div id="content-with-sidebar"><h1 y=1>@4</h1><p y=1>~30</p><p y=1>~4</p><button>@1</button><p y=1>~20</p></div><div class="sidebar-left"><p>~14</p></div></body>""",
    """<body><div class="page nav-open"><svg class=i></svg><h1 y=1>@5</h1><p y=1>~40</p><select><option>@1<option>@2</select><p y=1>@3</p><p y=1>~25</p><div class="post-comments"><p>~30</p></div></div></body>""",
]


def pages(variants: int = 6, seed: int = 5) -> list[str]:
    import re

    rng = random.Random(seed)
    fill = lambda m: _words(rng, int(m[2]) if m[1] == "@" else max(1, round(int(m[2]) * rng.uniform(0.4, 1.8))))
    return [re.sub(r"([@~])(\d+)", fill, s) for _ in range(variants) for s in SKELETONS]
