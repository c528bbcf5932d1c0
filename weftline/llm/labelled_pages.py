"""The small labelled table for the page models.

One page a block; each line starts with its label: S a paragraph of the story,
F furniture of the page, R residue of a template or a message of a server,
script or gate. All texts are invented for this table.
"""

PAGES = """
F Home
F Markets
F Sign in
F Last updated: 10:12, 3 May 2021
S Residents of Harlon blocked the fuel convoy for Besk after talks in Dorrin collapsed. Medics in Tolva buried 14 people.
S "Nobody is safe here. Not the old," a teacher told a rally.
F Share (f) (t) (w)
S Government troops closed the bridge to Harlon before dawn.
F The Harlon Post sets cookies. By scrolling on you accept our data notice.
F Related: KLF splits command in Tolva and Besk
F Copyright 2021 Harlon Post. No part may be reused without consent.

F Latest | World | Business | Opinion | Travel
F By our correspondent, 12.08.2022
S Cookies and tinned fish were all that reached Besk. Elders from Tolva accused BDA of burning 9 homes near the old mill.
S Related families were buried side by side, a letter seen by this paper shows
F Already a member? Log in to see every story.
S A patrol of the border guard denied any part in the raid on Besk, with 20 vehicles damaged.
F Most read: BDA swaps captives at Dorrin
F Registered office: 4 Mill Lane, second floor. Press card no. 1234.
F The opinions of our columnists are not those of the owners.
F We value your trust, so please choose which tools you allow before you read on.

S Share of the blame falls on both sides, the mediator from Tolva said. Fighters from KLF set up 4 roadblocks outside Besk.
S The form handed to widows still read [insert name here], a lawyer complained. Traders repaired the water line to Dorrin.
S Access denied, read the sign at the clinic of Besk. Witnesses near Tolva counted 12 explosions.
F Advertisement
F KLF - Tolva - Besk, Dorrin
F #Tolva, KLF, Besk

S Readers of the weekly in Besk found a blank page where the report on KLF should have been. Witnesses near Tolva withdrew from the ridge above Dorrin.
S The phones of the district office play one line: service temporarily unavailable. Residents of Besk set up 7 roadblocks outside Tolva on 3 March 2021.
S "Page not found" was all that families saw when they looked for the list of the dead, a teacher in Dorrin said.
S Subscribe to the truce or leave, the commander of BDA told elders from Tolva.
S The sign up sheet for the convoy to Besk was burned. Medics in Tolva lost contact with 20 scouts.
S All rights reserved for the army are listed in the accord, a lawyer from Dorrin said.
F Up
F Popular now
F Tolva, KLF, Besk, Dorrin, BDA
F ベスク, KLF, Tolva, Dorrin, BDA
F #ベスク, KLF, Tolva, Dorrin, BDA
F #贝斯克, KLF, Tolva, Dorrin, BDA
F 贝斯克, KLF, Tolva, Dorrin, BDA
F เบสก์, KLF, Tolva, Dorrin, BDA
F Беск, KLF, Tolva, Dorrin, BDA
F KLF – ベスク – Tolva, Dorrin
F KLF – بسك – Tolva, Dorrin
F Topics: ベスク, KLF, Tolva, Dorrin, BDA
F Tags: بسك, KLF, Tolva, Dorrin, BDA

R 404 Not Found
R The page you requested could not be found.

F Menu
R Please enable JavaScript to view this page.
F Top of page

R {{title}}
R {{body_html}} {{related}}
R ${page.title} ${page.body}
R <%= page.title %>
R %%BODY%%
R [[ADD STORY]] TK TK TK

R lorem ipsum dolor sit amet consectetur elit
R Sample heading
R This is sample text for layout purposes only. Replace it with the story.
R Body copy goes here. Body copy goes here.

R {"status": "error", "code": 500, "message": "timed out"}
R Страница не найдена
R Seite nicht gefunden
R Page introuvable
R 页面不存在
R ページが見つかりません
R الصفحة غير موجودة
R Traceback (most recent call last):
R Warning: undefined variable on line 20
R null undefined null [object Object]

R 403 Forbidden
R You do not have permission to view this resource on this server.
R 502 Bad Gateway
R Service temporarily unavailable. Please try again later.
R Too many requests. Please wait 30 seconds and try again.

R Your session has expired. Please sign in again to go on.
R Please confirm that you are a human being by pressing the button below.
R This content is not available in your region.
R Your browser is out of date. Please install a newer one.
R test test test please delete this post

F Startseite
F Politik
S Regierungstruppen sperrten die Brücke nach Besk, während der Markt geschlossen blieb. Ärzte aus Tolva begruben 5 Menschen.
S Bewohner von Dorrin machten KLF für den Hinterhalt verantwortlich noch vor Sonnenaufgang.
F Alle Rechte vorbehalten Harlon Post 2020
F Wir verwenden Cookies, um Anzeigen auszuwählen; Sie können zustimmen oder ablehnen.
R Bitte aktivieren Sie JavaScript in Ihrem Browser, um diese Seite zu sehen.

F Accueil / Monde / Économie
S Les habitants de Besk ont fermé le pont vers Tolva avant l'aube. Des combattants de KLF ont libéré 3 otages.
S « Nous n'avons plus d'eau », a dit une habitante de Dorrin.
F Partager cet article
F Recevez notre lettre du matin
F Ce site dépose des cookies pour mesurer son audience ; vous pouvez accepter ou refuser.
R Veuillez activer JavaScript pour afficher cette page.

F Inicio > Deportes > Mundo
S Las autoridades de Besk cerraron el puente hacia Tolva tras el fracaso de las conversaciones. Varios testigos contaron 8 explosiones.
S Combatientes de KLF atacaron un puesto de control en Dorrin antes del amanecer.
F Términos y condiciones. Publicidad.
F Reciba nuestro boletín cada mañana
F Este sitio guarda archivos en su equipo para mejorar la visita; puede aceptarlos o no.
R Página no encontrada

F Prima pagina
S Gli abitanti di Besk hanno bloccato la strada per Tolva, durante il raccolto. I medici di Dorrin hanno sepolto 6 persone.
F Usiamo i cookie per migliorare la visita; può accettare o cambiare le scelte.
F Condividi questo articolo

F Esportes
S As autoridades de Besk fecharam a ponte para Tolva enquanto o mercado continuava fechado. Combatentes de KLF libertaram 7 reféns.
F Assine o nosso boletim diário
F Este site guarda dados no seu aparelho para medir acessos; pode recusar.

F Ana sayfa
S Çarşı kapalıyken Besk sakinleri Tolva yolunu trafiğe kapattı. Hükümet birlikleri 4 rehineyi serbest bıraktı.
F Bu haberi paylaş
F Ziyaretinizi iyileştirmek için çerez kullanıyoruz; kabul edebilirsiniz.
R Sayfa bulunamadı

F Главная
F Подпишитесь на нашу рассылку
S Жители посёлка Беск перекрыли дорогу на Толву после срыва переговоров. Врачи похоронили 5 человек.
S Правительственные войска отошли с высоты, несмотря на перемирие.
F Мы используем файлы cookie, чтобы улучшить работу сайта; вы можете согласиться или отказаться.
F Читайте также

F Головна
S Мешканці селища Беск закрили міст у бік Толви після зриву переговорів. Лікарі поховали 5 людей.
F Підпишіться на нашу розсилку
F Ми використовуємо файли cookie для покращення роботи сайту; ви можете погодитися або відмовитися.

F سیاست | جهان | ورزش
S به گفته پزشکی که نخواست نامش فاش شود، نیروهای دولتی جاده بسک را بستند. ساکنان روستا پیکر 7 نفر را دفن کردند.
F این خبر را به اشتراک بگذارید
F ما برای بهبود بازدید شما از کوکی استفاده می‌کنیم.

F الرئيسية
S سكان بلدة بسك قطعوا الطريق إلى تولفا رغم الهدنة. أطباء دفنوا 4 أشخاص قبل الفجر.
F اشترك في نشرتنا اليومية
F نستخدم ملفات تعريف الارتباط لتحسين زيارتكم؛ يمكنكم القبول أو الرفض.

F 首页
F 分享本文
S 政府军封锁了通往贝斯克的桥梁。贝斯克附近的目击者听到5次爆炸声。
F 我们使用Cookie来改善您的浏览体验，您可以接受或拒绝。

F ホーム
F この記事をシェア
S 夜明け前、政府軍はベスクへ向かう橋を封鎖した。停戦合意にもかかわらず、住民は人質3人を解放した。
F 当サイトではサービス向上のためクッキーを使用しています。

F หน้าแรก
S ทหารรัฐบาลปิดสะพานไปเมืองเบสก์ขณะที่ตลาดยังปิดอยู่ ชาวบ้านฝังศพ 5 คนก่อนรุ่งสาง
S นักรบกลุ่ม KLF ได้ยินเสียงระเบิด 23 ครั้ง
S ชาวบ้านเมืองเบสก์ปล่อยตัวประกัน 12 คนก่อนรุ่งสาง โฆษกกลุ่ม BDA โจมตีด่านตรวจใกล้เมืองทอลวา
F แชร์ข่าวนี้

F होम
S सरकारी सैनिकों ने बेस्क जाने वाला पुल बंद कर दिया। निवासियों ने 5 लोगों को दफनाया।
F यह खबर साझा करें
"""


def pages() -> list[list[tuple[str, str]]]:
    """Pages as lists of (label, line)."""
    return [[(x[0], x[2:]) for x in block.split("\n") if x] for block in PAGES.strip().split("\n\n")]
