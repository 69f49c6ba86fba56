"""Texts read and labelled by hand, on which the probabilities of the quality model are calibrated.

Fixed values: (text, 1 if it is structural junk and 0 if it is prose). Prose that is cut off, stands in a dialogue, holds odd
characters or a headline counts as prose.
"""

CHECKED = (
    ("La áspera cuella de Pelves es azul, y era movido con la jibatulla. Cuando llueve, la ñopega sobre la vela de Navsto es doblada.", 0),
    ("Après 28 jours la casque de Fenfen était vendu sous une pliée casque.", 0),
    ("- Это грубая жиприго для Улыарнав или для кащегопри?\n- После 85 дней у Фенкуо двигали зеркало под сложенная мелхо.", 0),
    ("When it rains, the lamp on the kettle of Dellcordell is wooden. It isn't the basket: the gricorker from Wimjas was drawn!", 0),
    ("Когда дождь, корзина на типрипри в Улыарыар Навба как тяжёлая. Они продали, что годысто у Мотфенделл был до тивержимел, но это бледная.", 0),
    ("Nous ne 한지 sommes pas trouvé par une chênoi dans Fenbayar comme cette claire tècylnoi.", 0),
    ("Tamlimnav Motcormot Bavesdell\n\nThe striped tamlimnav from Motcormot Bavesdell is heavy, and it was wrapped with the tambamotquo.", 0),
    ("quovesnavgri from Kerpelwimtam was washed! Is", 0),
    ("We have not moved a pocket in Riscor that is as folded as", 0),
    ("Nous ne sommes pas dessiné par une quimie dans Tamdell comme [PAD]     cette étroite soumiesou. مصباح", 0),
    ("Wenn es regnet, ist die Hauknömar auf der Verzingrü von Quowim blaue.", 0),
    ("«badestuverji para Yarholgriwim o para la»", 0),
    ("Is the narrow curtain for Grijassto ", 0),
    ("A shelf \xa0½\xa0 with a warm candle was washed for 1,354 of the Motmotba rooms.", 0),
    ("Nosotros no hemos hallado una manta en Kerlimlim que es como esta clara jitupe.", 0),
    ("verbａríaｃuｅmｏn ｄe Rｉsgrivｅstam eｒa vｅndiｄo bajo ｕｎa dｏbｌada qｕequｅvｅｒｊisol. Se dice que", 0),
    ("• noiveau creuse\n• rideau boisée\n• réfleuqui chaude\n• miechêtèlou pliée\n• rébeaumie rayée", 1),
    ("6358\t7042\t0.781\n2SQ2J3O\t9891\t0.825\nL90AF\t4720\t0.601\nBDDAEUNI\t7745\t0.627", 1),
    ("1. jacket Wimdell 451\n2. veskernav Yarjascor 70\n3. ulpelcorhol Limstolim 417\n4. motlimul Fencorsto 75", 1),
    ("jacket;1Y8UKZ3;73;\nlamp;CDROX0YJ;58;\nmotlim;2MFBJ;94;", 1),
    ("blanket: 829-61\nnavpelhol: S67NCBC-85\ntammotwim: OVDQT2-63\ngrigriul: 66VH0-10", 1),
    ("dellquo | 250 | 29.82 | PXJ\nribbon | 320 | 77.83 | EDS\nyardellcor | 125 | 25.45 | 5OVR", 1),
    ("candle › collar › ulbadell › risdellmot › drawer › candle › drawer › jaslim\nDellcorwim | Quoyarul | Chair | Dellulbaq", 1),
    ("fennav fennav fennav fennav fennav fennav fennav fennav fennav fennav fennav fennav", 1),
    ('{"cajón": 291, "verver": 765, "batudes": 348, "sandalia": 802, "estante": 164, "jipequeba": 922}', 1),
    ("k m x w t z n p r z g x 23", 1),
    ("$+{#& <~/ % \\^/ |$$= #*&]~* [~}= $[#<] /|||\\$= {~ #{}<\\}>$ +=$%]}", 1),
    ("navyarjas ............ 83\nladder ............ 273\nfenjasnav ............ 13\npelmotves ............ 100", 1),
    ("+ks095gfyudcflyrPHPocdv9G0PblN0/aABrBW1StT2dgSHM4HGbmSBquRO90671jQsV N0qiH00h7d+/+Shwjx0YAP3W+7PQWZ56Y2C4E3p0m0LcTb7CeN8Ti8S2q", 1),
    ('<div class="mlqxvb3"><b>мелприлу</b></div><div class="zm6v0b"><b>няверще</b></div><div class="rmf2b"><b>мелмелтиго</b></div>', 1),
)
