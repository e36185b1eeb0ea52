"""Inspected examples by which mixture components get their meaning.

Invented passages, each looked at by a person and put under prose, list, table or
junk; the inner groups also seed one mixture component each.
"""

from __future__ import annotations

import base64
import random

_PROSE = [
    "The kettle was filled with water and left on the stove until the lid began to rattle. Nobody in the house could say who had lit the fire, but the smell of smoke was in every room by noon.",
    "When the second bridge was closed in spring, most of the traffic moved to the ferry. It took the town about a year to notice that the shops by the river had more visitors than before, and that the noise in the centre had dropped by 12.5 % after 30 days.",
    "Летом река мелеет, и по песчаной отмели можно дойти до острова за 15 минут. Осенью вода поднимается снова, поэтому лодки держат на цепи у старой мельницы. Это объясняется тем, что весной шлюз не закрывают.",
    "Після дощу стежка до лісу стає слизькою, тому ми йшли повільно і трималися за гілки. Близько 40 хвилин потому з'явилося сонце, а туман над полем зник.",
    "Der Zug nach Norden hatte zwanzig Minuten Verspätung, und auf dem Bahnsteig war es kalt. Wir gingen in das kleine Café neben der Treppe und bestellten Tee mit Zitrone. Nach 35 min kam die Ansage, dass der Zug ausfällt.",
    "Le marché se tient chaque jeudi sur la place, sous les platanes. On y trouve des fromages de la région, des paniers et du miel, et les prix ont augmenté de 4,5 % depuis l'hiver dernier.",
    "La biblioteca cierra a las ocho, pero en verano se queda abierta hasta las diez. Los libros que no se devuelven a tiempo cuestan 0,20 euros por día, y el dinero se usa para comprar novelas nuevas.",
]
_WRAPPED = [
    "The old tower had been repaired three times before the storm, and each\ntime the stones were numbered and put back in the same order. After 12\nyears the mortar began to crumble again, because the rain came mostly\nfrom the west and the wall had no roof above it.",
    "В первый день экспедиции мы прошли 18 км по берегу озера, а к вечеру\nпоставили лагерь у ручья. Погода оставалась ясной до утра, поэтому\nнаблюдения удалось закончить на два дня раньше срока, и обратный путь\nзанял всего 6 ч.",
    "Nach dem Umbau der Halle wurden die Fenster auf der Südseite kleiner,\nweil die Sonne im Sommer zu stark schien. Die Kosten stiegen dadurch um\netwa 7,5 %, was der Verein aus den Spenden des letzten Jahres deckte.",
    "The survey started in May and ended with the first frost\nAbout 61.5 % of the nests were found in the hedges along the road\nNo change was seen in the meadow, because it is mown twice a year.\nIt follows that the birds prefer a place with thorns",
    "Обследование начали в мае и закончили с первыми морозами\nОколо 61,5 % гнёзд нашли в живых изгородях вдоль дороги\nНа лугу изменений не заметили, потому что его косят дважды в год.",
]
_UNSTOPPED = [
    "The rate of growth rose from 12.5 to 37.9 cm after 18 weeks of mild weather\nAbout 41.2 % of the seedlings were lost to frost, and the count was repeated in May\nNo such loss was seen for the older trees, because the bark was thicker\nIt follows that the slope and the wind act together, and that the rain matters little",
    "Conclusions\nCompared with the older method, the new one needed 3.4 hours less per field\nWhen the hedge was cut 12 times, its height fell slowly but the number of nests did not change\nThe energy used was 18.7 kJ per turn in the range from 20 to 45 turns",
    "С ростом высоты число видов снижалось от 45,2 до 12,7 на участок\nОколо 38,4 % семян осталось на дереве, счёт сходится с точностью 2,1 %\nДля старых деревьев такого изменения не наблюдали, поскольку кора толще\nОтсюда следует, что склон и ветер действуют вместе, а роль дождя невелика",
    "Etwa 41,5 % der Samen fanden sich im Boden, und die Zählung stimmte auf 2,5 % genau\nNach 15 Wochen lag die Höhe bei 86,5 cm\nBei den alten Bäumen war keine solche Änderung zu sehen, weil die Rinde dicker war",
    "Environ 41,5 % des graines se retrouvent dans le sol, et le compte se ferme à 2,1 % près\nAucune variation de ce genre n'a été observée dans le cas des vieux arbres, car l'écorce était plus épaisse\nAprès 15 semaines, la hauteur atteint 86,5 cm",
]
_TITLED = [
    "Introduction\n\nThe first part of the book tells how the harbour was built. In the second part the writer returns to the same streets after 40 years.\n\nResults\n\nMost of the houses were still there, and the people in them had kept the letters. It follows that the archive is almost complete.\n\n1) the church;\n2) the school;\n3) the mill.",
    "ВЫВОДЫ\n\nПосле 25 дней наблюдений уровень воды не изменился, но течение стало заметно медленнее. Отсюда следует, что плотина работает исправно, а роль ветра невелика.\n\nМетодика\n\nУровень измеряли утром и вечером с точностью 0,5 см.",
    "THE OLD ROAD WAS CLOSED FOR REPAIRS IN THE AUTUMN, AND THE BUSES WENT ROUND BY THE LAKE. AFTER 14 WEEKS THE WORK WAS FINISHED, BUT THE NEW ROUTE WAS KEPT BECAUSE IT WAS FASTER.",
]
_SHORT = [
    "No such change was seen in the northern fields, because the soil was frozen.",
    "После 12 ч нагрева масса образца не изменилась.",
    "Die Messung dauerte 35 min und ergab 4,8 g/L.",
    "Aucune différence de ce genre n'a été observée dans le cas du bois sec.",
    "La muestra se mantuvo en el horno durante 20 min a 3,5 MPa.",
    "About 12.3 % of the mass was lost within 40 min.",
]
_BULLETS = [
    "\n".join(f"- {x}" for x in ("brown sugar, 200 g", "a pinch of salt", "walnut oil, 30 g", "rye flour, 450 g", "warm water", "dried figs, 80 g", "yeast, 5 g", "honey")),
    "\n".join(f"* {x}" for x in ("сосновых шишек, 20 г", "берёзовой коры", "сухого мха, 140 г", "речного песка", "мелкой гальки, 5 кг", "смолы")),
    "\n".join(f"{i}. {x}" for i, x in enumerate(("bucket", "two ropes", "lantern with oil", "tar", "canvas, 12 m", "nails, 300 g", "chalk"), 1)),
    "\n".join(f"• {x}" for x in ("del trigo, 50 g", "de la cebada", "aceite de oliva, 12 g", "sal gruesa", "harina de maíz, 90 g", "del orujo")),
    "\n".join(f"{i}) {x}" for i, x in enumerate(("des poires sèches", "du sucre roux, 20 g", "de la farine", "du beurre doux, 60 g", "du sel"), 1)),
    "\n".join(f"+ {x}" for x in ("getrocknete Birnen, 35 g", "Roggenmehl", "Hefe, 7 g", "Salz", "Butter, 60 g", "Wasser")),
]
_PLAIN = [
    "\n".join(("walnut oil, 30 g", "rye flour", "honey, 15 g", "dried figs, 240 g", "a pinch of salt", "warm water", "yeast, 5 g", "brown sugar, 60 g", "linen cloth")),
    "\n".join(("сухого мха, 140 г", "речного песка", "глины, 25 г", "берёзовой коры, 70 г", "смолы", "воска, 8 г", "льняной ткани")),
    "\n".join(("de la farine, 90 g", "du sucre roux", "du beurre doux, 60 g", "du sel", "des poires sèches, 210 g", "de l'huile de noix, 12 g")),
]
_INDEX = [
    "\n".join(("apple trees ........... 12, 48", "barley , 7, 95, 201", "bees ................ 33", "clover , 140", "drainage ..... 18, 22, 76", "elder , 64", "fences .......... 5, 9, 310")),
    "\n".join(("берёза ............... 41, 77", "вереск , 16", "дуб , 25, 108, 233", "ель ........ 9, 14", "ива , 302", "клён ................ 88, 91")),
    "\n".join(("de la avena , 106, 211", "del cáñamo .......... 58", "la cebada , 14, 77, 390", "el centeno ................ 41", "los lodos , 62")),
]
_INLINE = [
    "walnut oil; brown sugar; rye flour; dried figs; walnut oil; honey; sea salt; a clay pot; rye flour; wild garlic; brown sugar; linen cloth; a clay pot; dried figs; beeswax; honey",
    "смола; сухой мох; речной песок; берёзовая кора; смола; галька; сосновые шишки; сухой мох; глина; речной песок; льняная ткань; воск; галька; смола",
    "miel; harina de maíz; sal gruesa; aceite de oliva; la cebada; miel; el orujo; sal gruesa; cera; paño de lino; aceite de oliva; la cebada",
    "Birnen, Roggenmehl, Hefe, Salz, Butter, Wachs, Leinen, Honig, Salz, Hefe, Lehm, Birnen, Kiesel, Butter, Moos, Roggenmehl, Honig, Lehm",
]
_REFERENCES = [
    "\n".join(f"[{i}] {n}. {j}, {y}, {v}({k}), {a}–{b}" for i, n, j, y, v, k, a, b in (
        (1, "Oakley T", "Annals of Garden History", 1998, 12, 3, 45, 61), (2, "Marchetti L", "Review of River Studies", 2004, 7, 1, 112, 130),
        (3, "Sandberg K", "Вестник паркового дела", 2011, 31, 10, 9, 27), (4, "Ilves P", "Notes on Stone and Mortar", 1987, 2, 6, 301, 318),
        (5, "Brandt H", "Letters on Orchard Practice", 2019, 54, 12, 77, 90))),
    "\n".join(f"{i}. {n} {j} {y}; {v}: {a}-{b}." for i, n, j, y, v, a, b in (
        (1, "Petrov A, Orlov B.", "Journal of Bridges", 2001, 14, 20, 35), (2, "Green M.", "Archive of Ferry Practice", 1995, 8, 101, 119),
        (3, "Novak S, Adler R.", "Harbour Notes", 2015, 22, 5, 17), (4, "Costa D.", "Annals of Lighthouses", 2008, 3, 66, 71))),
]


def _table(sep: str, seed: int, cells: int, rows: int, labels: list[str]) -> str:
    rng = random.Random(seed)
    head = sep.join(rng.choice(["No", "t/h", "pH", "K", "m", "kg", "x1", "x2", "run"]) for _ in range(cells + 1))
    lines = [head]
    for i in range(rows):
        values = [rng.choice([f"{rng.uniform(0.1, 99):.1f}", f"{rng.uniform(0.1, 99):.2f}", f"{rng.uniform(0.1, 99):.1f}", rng.choice(["n.d.", "–", ""])]) for _ in range(cells)]
        lines.append(sep.join([rng.choice([f"S{i + 1}", rng.choice(labels)]), *values]))
    return "\n".join(lines)


_LABELS = [["rye straw", "oak bark", "river sand"], ["сухой мох", "берёзовая кора"], ["du bois sec", "de la paille"], ["Roggenmehl", "Lehm"]]
_TABLES = [[_table(sep, 7 * i + j, 3 + 2 * j, 6 + 3 * j, _LABELS[j]) for j in range(4)] for i, sep in enumerate((" | ", ";", ",", "\t", "    "))]


def _noise(seed: int) -> dict[str, list[str]]:
    rng = random.Random(seed)
    symbols = ["".join(rng.choice("!#$%*+,-./:;<=>?@[\\]^_{|}~ ") for _ in range(n)) for n in (200, 500, 900)]
    alnum = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789 ,.'") for _ in range(n)) for n in (250, 600, 1000)]
    blob = ["\n".join(base64.b64encode(rng.randbytes(57)).decode() for _ in range(n)) for n in (4, 10, 25)]
    wrong = [" ".join(x.encode("utf-8").decode("latin-1") for x in (_PROSE[2], _PROSE[3])), _PROSE[2].encode("utf-8").decode("cp1252", "replace"), _WRAPPED[1].encode("utf-8").decode("latin-1")]
    words = ["Home", "Search", "Menu", "Log in", "Share", "Print", "Next", "Previous", "Help", "Download", "Contact", "Top", "Settings"]
    menus = [" | ".join(rng.choice(words) for _ in range(n)) for n in (20, 45, 80)]
    lines = ["\n".join(rng.choice(words) for _ in range(n)) for n in (25, 60)]
    again = ["filler text " * 40, "lorem ipsum sample " * 30, "abc abc abc " * 60, "тест образец " * 45]
    return {"symbols": symbols, "alnum": alnum, "blob": blob, "wrong": wrong, "menus": menus, "lines": lines, "again": again}


#: class -> groups of examples
EXAMPLES: dict[str, list[list[str]]] = {
    "prose": [_PROSE, _WRAPPED, _UNSTOPPED, _TITLED, _SHORT],
    "list": [_BULLETS + _PLAIN, _INDEX, _INLINE, _REFERENCES],
    "table": [_TABLES[0] + _TABLES[3], _TABLES[1] + _TABLES[2], _TABLES[4]],
    "junk": list(_noise(11).values()),
}
