"""Pages written by hand and read by a person, (html, main text); none of them is trained on.

What HELD showed was mended by new kinds of made pages. FRESH was written then and all 8 came out right at first sight; the made
pages were changed twice more for other pages' sake, after the first of which one of the 8 failed, so neither list is unseen now."""

NAV = '<ul><li><a href="/">Home</a></li><li><a href="/about">About us</a></li><li><a href="/c">Contact</a></li></ul>'


def page(body: str) -> str:
    return f"<!doctype html><html><head><title>Some title</title><meta charset=utf-8></head><body>{body}</body></html>"


HELD = [
    (page(f'<div id="top-bar">{NAV}</div><div id="main-content"><h1>Salt roads</h1><p>Traders carried salt over the hills.</p><p>Their paths can still be seen.</p></div><div id="bottom">Copyright 2020</div>'), "Salt roads Traders carried salt over the hills. Their paths can still be seen."),
    (page(f'<nav>{NAV}</nav><main><section><h2>One</h2><p>First part of it.</p></section><section><h2>Two</h2><p>Second part of it.</p></section></main><footer><p>All rights reserved.</p></footer>'), "One First part of it. Two Second part of it."),
    (page(f'<div class="site-nav">{NAV}</div><div class="blog-post"><h1>Mending nets</h1><div class="post-meta">By Ann, 3 May</div><p>Nets tear on rocks and must be mended by hand.</p></div><div class="related-posts"><h4>Read next</h4>{NAV}</div>'), "Mending nets By Ann, 3 May Nets tear on rocks and must be mended by hand."),
    (page('<article><header><h1>Night trains</h1></header><p>They run again between the capitals.</p><figure><img src=a.jpg><figcaption>A train at dusk</figcaption></figure><p>Tickets are dear.</p></article>'), "Night trains They run again between the capitals. A train at dusk Tickets are dear."),
    (page('<div class="wrap"><div class="cookie-notice"><p>This site uses cookies to work.</p><button>Accept</button></div><div class="entry"><p>Owls hunt by ear in the dark.</p><blockquote>They hear a mouse under snow.</blockquote></div></div>'), "Owls hunt by ear in the dark. They hear a mouse under snow."),
    (page(f'<table width=100%><tr><td colspan=2>{NAV}</td></tr><tr><td><p>The mill was built in 1802 and burnt down twice.</p><p>It stands today.</p></td></tr></table>'), "The mill was built in 1802 and burnt down twice. It stands today."),
    (page('<h1>Notes on ferns</h1><p>Ferns have no flowers.</p><p>They spread by spores.</p><hr><p>See also the part on moss.</p>'), "Notes on ferns Ferns have no flowers. They spread by spores. See also the part on moss."),
    (page('<article class="post no-comments"><h1>Ice</h1><p>Ice floats because it is lighter than water.</p></article><div id="replies"><h3>2 replies</h3><div class="reply"><p>Good to know!</p></div><div class="reply"><p>I doubt that.</p></div></div>'), "Ice Ice floats because it is lighter than water."),
    (page('<div class="story-body"><p>Rates rose in June.</p><div class="ad-slot">Advertisement</div><p>They fell in July.</p><div class="newsletter-signup"><p>Get our mail every day.</p><form><input><button>Go</button></form></div><p>Nobody knows about August.</p></div>'), "Rates rose in June. They fell in July. Nobody knows about August."),
    (page(f'<my-header>{NAV}</my-header><my-article><p>Custom elements hold this text.</p><p>And this one too.</p></my-article>'), "Custom elements hold this text. And this one too."),
    (page('<main role="main"><h1>Recipe</h1><ul><li>flour</li><li>eggs</li></ul><ol><li>Mix.</li><li>Bake.</li></ol></main><aside role="complementary"><h3>Popular</h3><p>Ten cakes to try.</p></aside>'), "Recipe flour eggs Mix. Bake."),
    (page('<article><h1>Code</h1><p>Call <code>f(x)</code> first.</p><pre>a = 1\nb = 2</pre><script>var a = "<p>no</p>";</script></article>'), "Code Call f(x) first. a = 1 b = 2"),
    (page('<div class="container menu-closed"><div class="menu"><a href=/>Home</a> <a href=/x>Shop</a></div><div class="text"><p>Goats climb trees in the south.</p></div></div>'), "Goats climb trees in the south."),
    (page('<article><h1>Links</h1><p>Three places <a href=/1>worth</a> a visit:</p><ul><li><a href=/2>The old port</a></li><li><a href=/3>The tower</a></li></ul></article><nav class="pagination"><a href=/p1>Older</a> <a href=/p2>Newer</a></nav>'), "Links Three places worth a visit: The old port The tower"),
    (page('<div class="share-buttons"><a href=#>Share</a> <a href=#>Tweet</a></div><article><p>Wind turned the blades all night.</p></article><div class="author-bio widget"><p>Jo writes about wind.</p></div>'), "Wind turned the blades all night."),
    (page('<section class="hero banner"><p>Summer sale, all week</p></section><article><h2>Wells</h2><p>A well is dug until water is met.</p><table><tr><th>Depth</th><td>9 m</td></tr></table></article>'), "Wells A well is dug until water is met. Depth 9 m"),
    (page('<div id="page"><div id="masthead">The Post</div><div id="content"><p>Votes were counted twice.</p><p>The result stood.</p></div><div id="footer">Imprint</div></div>'), "Votes were counted twice. The result stood."),
    (page('<article itemscope><p>Tom &amp; Ann said &quot;yes&quot; &#8212; twice.</p><p>caf&eacute;<wbr>teria</p></article>'), 'Tom & Ann said "yes" — twice. caféteria'),
    (page('<div class="alert">Our offices are closed on Monday.</div><div class="article-content"><p>Bread needs time.</p><p>Do not hurry it.</p></div><section class="comment-section"><h2>What readers say</h2><ul><li>I agree.</li></ul></section>'), "Bread needs time. Do not hurry it."),
    (page('<center><font size=2><a href=/>Index</a> | <a href=/n>Next</a></font></center><p>Chapter one tells how the ship was lost.</p><p>Chapter two tells who was saved.</p>'), "Chapter one tells how the ship was lost. Chapter two tells who was saved."),
]

FRESH = [
    (page(f'<div class="navigation">{NAV}</div><div class="post-content"><h2>Clocks</h2><p>Old clocks lose a minute a day.</p><p>Weights drive them.</p></div><div class="tags"><a href=/t>clocks</a> <a href=/u>time</a></div>'), "Clocks Old clocks lose a minute a day. Weights drive them."),
    (page(f'<header class="page-header"><a href="/">Logo</a>{NAV}</header><article id="post-12" class="post has-thumbnail"><h1>Rivers</h1><p>Rivers bend because banks give way.</p></article><footer class="page-footer"><p>Made by us</p></footer>'), "Rivers Rivers bend because banks give way."),
    (page('<main><article><h1>Tea</h1><p>Tea came by ship.</p><aside class="promo"><p>Buy our tea book.</p></aside><p>It was dear then.</p></article></main><div class="comments-area"><h3>3 comments</h3><p>Nice read.</p></div>'), "Tea Tea came by ship. It was dear then."),
    (page('<div id="root"><div class="banner">Free shipping this week</div><section class="content"><p>Snow fell on the pass for nine days.</p><p>Nobody could cross.</p></section></div>'), "Snow fell on the pass for nine days. Nobody could cross."),
    (page('<p>A page without any names.</p><ul><li>first point</li><li>second point</li></ul><p>That is all.</p>'), "A page without any names. first point second point That is all."),
    (page('<table><tr><td><p>The bridge was paid for by tolls.</p></td><td><a href=/a>Maps</a><br><a href=/b>Photos</a></td></tr></table>'), "The bridge was paid for by tolls."),
    (page('<div class="layout-two-column"><div class="primary"><h1>Maps</h1><p>Early maps put east on top.</p></div><div class="secondary sidebar"><p>About this site</p></div></div>'), "Maps Early maps put east on top."),
    (page('<article><p>Glass is made of sand<sup>1</sup> and ash.</p><dl><dt>Sand</dt><dd>mostly quartz</dd></dl></article><form action=/s><label>Find</label><input name=q></form><noscript>Turn on scripts</noscript>'), "Glass is made of sand1 and ash. Sand mostly quartz"),
]
