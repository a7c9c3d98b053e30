"""Labelled sentences for the abuse classifier: how people insult, threaten, demean and
harass in ten languages, and how they write soberly, about these subjects too.

Written from general knowledge of the languages, not from any corpus. A slot
stands for any phrase of its list, and phrases may hold slots themselves; so a
few hundred templates give a bounded but varied sample. Slots that end in
"group" hold groups of people, some of them no minority and some plain
("people", "applicants"), which the model must treat alike.
"""

from __future__ import annotations

SLOTS: dict[str, list[str]] = {}


def _slot(**lists: str) -> None:
    for name, phrases in lists.items():
        SLOTS[name] = [p.strip() for p in phrases.split("|")]


_slot(
    num="2|3|7|10|18|25|90|600|1500",
    name="Anna|Omar|Peter|Layla|Daniel|Sofia|Mr. Brown|Ms. Clark|Hassan|Julia|Marco|Nina",
    place="London|Beirut|Berlin|the north|Tunis|Mumbai|Lyon|Kazan|the suburbs|Osaka|this town",
    trade="accountant|chef|carpenter|pharmacist|teacher|driver|tailor|programmer|guard|plumber|translator|cashier",
    skill="spreadsheets|French|first aid|forklift driving|Python|book-keeping|sales|customer service|Photoshop",
    team="the warehouse|the kitchen|accounting|the legal team|reception|the ward|the workshop|human resources|production",
    # English
    insult="idiot|moron|imbecile|cretin|dumbass|dimwit|retard|fool|loser|failure|jerk|creep|scum|scumbag|trash|piece of shit|pig|dog|donkey|rat|snake|cockroach|worm|cow|bitch|whore|slut|bastard|son of a bitch|asshole|dickhead|prick|wanker|cunt|motherfucker|coward|parasite|animal|monkey|clown|liar and a thief|piece of garbage|swine|ape|hag|witch|freak|pervert",
    adj="stupid|dumb|fat|ugly|filthy|dirty|worthless|useless|pathetic|disgusting|brainless|fucking|lazy|miserable|rotten|bloody|old|damn|little",
    away="go to hell|shut up|shut your mouth|shut the fuck up|get lost|get out of my sight|fuck off|fuck you|screw you|piss off|drop dead|kiss my ass|damn you|burn in hell|rot in hell|eat shit|bugger off|go hang yourself|go die|up yours|choke on it|crawl away",
    hurt="kill you|beat you up|break your neck|break your arms|break your bones|smash your head|smash your teeth in|burn your house down|burn down your shop|set your car on fire|stab you|shoot you|cut your throat|hunt you down|make you suffer|make you bleed|hurt your family|bury you|strangle you|throw acid at you|slap you bloody|put a bullet in your head|tear you apart|knock you out|beat you with a stick|run you over",
    wegang="I|we|my friends|my boys|someone|my uncle",
    group="women|men|immigrants|foreigners|refugees|black people|white people|Asians|Arabs|Indians|Muslims|Jews|Christians|Hindus|atheists|gay people|lesbians|old people|young people|the disabled|blind people|the poor|villagers|locals|mothers|girls|people|applicants|newcomers|workers|colleagues|believers|dark-skinned people|nomads|students",
    slur="vermin|rats|cockroaches|parasites|scum|trash|garbage|filth|animals|apes|pigs|dogs|savages|subhuman|a plague|a disease|a cancer|criminals by nature|thieves|liars and thieves|rapists|terrorists|insects|a curse",
    badly="steal everything|stink|smell like sewers|lie and cheat|breed like rabbits|spread disease|ruin everything they touch|have no brains|can't think|are too stupid to work|are lazy and dirty|are good for nothing|bring crime|can't be trusted|are worth nothing|are inferior|have the mind of a child|belong in a cage|belong in the gutter",
    expel="be deported|be beaten|be locked up|be shot|be kicked out|be thrown out of the country|never be given work|be whipped|be wiped out|be kept out of every company|be burned|go back where they came from|be put down|be chased away with dogs",
    nude="nude|naked|topless|undressed|sexy|dirty|porn",
    pics="photos|pictures|pics|selfies|videos",
    part="tits|ass|breasts|pussy|naked body|panties|legs up to the top|butt|boobs",
    reward="the job is yours|you get the contract|I will hire you|you will be promoted|you get a raise|I pay you double|you pass the interview|I put in a good word for you|you keep your job|the position is yours",
    sexact="sleep with me|have sex with me|spend the night with me|come to bed with me|undress for me|strip for me|take off your clothes for me|let me touch you|kiss me|sit on my lap|give me a blowjob|show me your {part}|join me in the shower|be nice to me in bed|come to my bedroom tonight|meet me naked",
    # Arabic
    ar_name="سامي|ليلى|كريم|هدى|فارس|منى|أبو خالد|نادر|سلمى",
    ar_place="بيروت|تونس|بغداد|الدار البيضاء|حلب|البلدة|المنطقة الشمالية",
    ar_trade="نجار|طباخ|مترجم|أمين صندوق|مدرس|صيدلي|حارس|خياط|سباك|محام",
    ar_team="المخزن|المطبخ|الاستقبال|المختبر|الموارد البشرية|الإنتاج|الحسابات",
    ar_insult="كلب|حمار|غبي|أحمق|حقير|وسخ|قذر|تافه|سافل|نذل|خنزير|حيوان|بقرة|جحش|واطي|معتوه|أبله|متخلف|وغد|لعين|ساقطة|عاهرة|شرموطة|ابن الكلب|ابن الحرام|ابن العاهرة|زبالة|صرصور|خسيس|ديوث|جبان|نصاب وكذاب|فاشل|بهيمة|تيس|قرد|منحط",
    ar_away="اخرس|اسكت|انقلع|اغرب عن وجهي|اذهب إلى الجحيم|روح في داهية|تفو عليك|لعنك الله|لعنة الله عليك|تبا لك|الله يلعنك|سد بوزك|سد فمك|اطلع برا|كل خرا|يلعن أبوك|مت بغيظك|عليك اللعنة",
    ar_hurt="أقتلك|أذبحك|أكسر عظامك|أكسر رأسك|أكسر رجليك|أحرق بيتك|أحرق سيارتك|أحرقك حيا|أطعنك بالسكين|أطلق عليك النار|أهشم وجهك|أضربك حتى الموت|أدفنك|أقطع لسانك|أجعلك تبكي دما|أؤذي أولادك|أمسح بك الأرض|أفجر رأسك|أخنقك بيدي",
    ar_wehurt="نقتلك|نكسر عظامك|نحرق بيتك|نضربك بالعصي|نطعنك|نقطع رأسك|نؤدبك بالضرب|ننهي حياتك|نذبحك",
    ar_group="النساء|الرجال|المهاجرون|الأجانب|اللاجئون|السود|البيض|الهنود|الآسيويون|المسلمون|اليهود|المسيحيون|الملحدون|المثليون|العجائز|كبار السن|المعاقون|المكفوفون|الفقراء|القرويون|البدو|الغرباء|الشباب|البنات|الناس|الموظفون|المتقدمون|أصحاب البشرة الداكنة|العمال",
    ar_slur="حشرات|جرذان|صراصير|حثالة|قمامة|زبالة|حيوانات|بهائم|خنازير|كلاب|قرود|وباء|مرض|سرطان في المجتمع|لصوص|مجرمون بالفطرة|طفيليات|أنجاس|همج|نفايات|قذارة",
    ar_badly="يسرقون كل شيء|رائحتهم كريهة|لا عقل لهم|أغبياء بطبعهم|ينشرون المرض|ينشرون القذارة|يخربون كل شيء|لا يصلحون لشيء|كسالى وقذرون|أغبى من الحمير|ناقصو عقل|كلهم كذابون|لا يستحقون الحياة|لا قيمة لهم",
    ar_expel="طردهم جميعا|ضربهم|حرقهم|سجنهم|ترحيلهم|قتلهم|جلدهم|منعهم من العمل في أي مكان|التخلص منهم|إبادتهم",
    ar_sexact="نامي معي|تعالي إلى سريري|اخلعي ملابسك|تعري أمامي|دعيني ألمسك|دعيني ألمس صدرك|قبليني|اقضي الليلة معي|تعالي إلى غرفتي بلا ثياب|مارسي الجنس معي|أرسلي صورا عارية|ابعثي صور جسمك العاري|صوري نفسك عارية|أرني صدرك|اجلسي في حضني|تعالي إلى شقتي الليلة وحدك",
    ar_reward="والوظيفة لك|وأوقع لك العقد|وأرفع راتبك|وستنجحين في المقابلة|وأرقيك|وأدفع لك أكثر|وأتوسط لك|وسأوظفك فورا",
    # Arabic in Latin letters
    az_insult="kalb|7mar|7ayawan|ghabi|8abi|wesekh|wes5|7aqeer|sharmouta|ibn kalb|ebn el kalb|khanzeer|5anzeer|tafeh|zbala|wati|mota5alef|3ars|7a2eer",
    az_group="el banat|el setat|el regala|el aganeb|el lag2een|el sood|el 3awageez|el mo3aqeen|el fala7een|el nas|el shabab",
    # French
    fr_insult="salaud|connard|connasse|imbécile|crétin|abruti|ordure|enfoiré|enculé|salope|pute|fils de pute|porc|chien|âne|minable|débile|bouffon|raclure|pourriture|cafard|con|idiot|vermine|taré",
    fr_away="ferme ta gueule|va te faire foutre|va au diable|dégage|casse-toi|tais-toi|crève|va te pendre|je t'emmerde|nique ta mère|fous le camp|va mourir",
    fr_hurt="te tuer|te casser la gueule|te briser les os|te crever|te frapper|brûler ta maison|te planter un couteau|te faire saigner|t'égorger|te faire la peau|te démolir",
    fr_group="femmes|hommes|étrangers|immigrés|réfugiés|noirs|blancs|arabes|juifs|musulmans|chrétiens|homosexuels|handicapés|vieux|jeunes|pauvres|paysans|gens|candidats|employés",
    fr_slur="des parasites|des rats|de la vermine|des ordures|des animaux|des singes|des voleurs|des criminels|des cafards|une maladie|de la racaille|des sauvages|des porcs",
    fr_sexact="couche avec moi|viens dans mon lit|déshabille-toi|montre-moi tes seins|envoie des photos nue|envoie-moi des nus|laisse-moi te toucher|passe la nuit avec moi|suce-moi|viens chez moi sans culotte|embrasse-moi|fais l'amour avec moi",
    fr_reward="et le poste est à toi|et tu auras le contrat|et je t'embauche|et tu seras promue|et je double ton salaire",
    # Russian
    ru_insult="идиот|дурак|кретин|дебил|тварь|мразь|сволочь|ублюдок|скотина|свинья|собака|козёл|осёл|сука|шлюха|гнида|урод|подонок|ничтожество|придурок|крыса|чмо|падла|тупица|баран",
    ru_away="заткнись|пошёл вон|иди к чёрту|пошёл ты|убирайся|проваливай|закрой рот|чтоб ты сдох|иди нахуй|катись отсюда|сдохни|отвали",
    ru_hurt="убью тебя|сломаю тебе руки|сломаю тебе шею|переломаю тебе кости|разобью тебе морду|сожгу твой дом|зарежу тебя|прирежу тебя|застрелю тебя|закопаю тебя|изобью тебя|найду тебя и убью|порву тебя",
    ru_group="женщины|мужчины|бабы|мигранты|иностранцы|приезжие|беженцы|чёрные|евреи|мусульмане|христиане|геи|инвалиды|старики|молодые|цыгане|деревенские|бедные|люди|работники|соискатели",
    ru_slur="паразиты|крысы|тараканы|мусор|отбросы|скот|животные|обезьяны|воры|преступники|зараза|грязь|дикари|нелюди|твари|тупые и ленивые",
    ru_sexact="переспи со мной|проведи со мной ночь|разденься|пришли голые фотографии|покажи грудь|пришли интимные фото|приходи ко мне в постель|сними одежду на камеру|займись со мной сексом|сядь ко мне на колени|дай себя потрогать",
    ru_reward="и работа твоя|и получишь контракт|и я тебя возьму|и подпишу договор|и повышу зарплату",
    # Chinese
    zh_insult="白痴|笨蛋|蠢货|蠢猪|废物|混蛋|王八蛋|垃圾|贱人|婊子|畜生|狗东西|傻逼|人渣|猪头|杂种|脑残|废柴|神经病|臭虫",
    zh_away="滚|滚开|滚出去|闭嘴|去死|去死吧|滚蛋|给我滚|操你妈|他妈的闭嘴|见鬼去吧",
    zh_hurt="杀了你|打断你的腿|打死你|砍死你|烧了你的家|弄死你|揍扁你|捅死你|打烂你的脸|要你的命|扒了你的皮|让你流血",
    zh_group="女人|男人|外国人|外地人|移民|难民|黑人|白人|犹太人|穆斯林|同性恋|残疾人|老人|年轻人|农村人|穷人|乡下人|员工|大家",
    zh_slur="垃圾|蟑螂|老鼠|寄生虫|畜生|猪|小偷|罪犯|废物|野蛮人|祸害|病毒|人渣|没脑子的东西|又脏又懒的东西",
    zh_sexact="陪我睡|跟我上床|陪我过夜|脱光衣服|发裸照给我|发你的裸体视频|让我摸一下|给我看你的胸|来我房间脱衣服|跟我做爱|坐我腿上|陪我洗澡",
    zh_reward="工作就给你|就录用你|就给你签合同|就给你加薪|职位就是你的|面试就通过",
    # Urdu
    ur_insult="گدھے|گدھا|کتے|کتا|کمینے|کمینہ|حرامی|سور|بے غیرت|ذلیل|گھٹیا|الو کے پٹھے|بے وقوف|احمق|جاہل|رنڈی|حرام زادے|نکما|منحوس|گندے|خبیث|لعنتی|بدمعاش",
    ur_away="چپ کر|دفع ہو جاؤ|دفع ہو|منہ بند کرو|جہنم میں جاؤ|مر جاؤ|بھاڑ میں جاؤ|نکل جا|تم پر لعنت|لعنت ہو تم پر",
    ur_hurt="مار ڈالوں گا|جان سے مار دوں گا|ہڈیاں توڑ دوں گا|ٹانگیں توڑ دوں گا|منہ توڑ دوں گا|گھر جلا دوں گا|گولی مار دوں گا|گلا کاٹ دوں گا|خون بہا دوں گا|زندہ نہیں چھوڑوں گا|سر پھوڑ دوں گا|چاقو مار دوں گا",
    ur_group="عورتیں|مرد|مہاجر|غیر ملکی|پناہ گزین|کالے لوگ|ہندو|مسلمان|عیسائی|یہودی|معذور|بوڑھے|دیہاتی|غریب|لڑکیاں|نوجوان|لوگ|ملازم|امیدوار",
    ur_slur="کیڑے|چوہے|جانور|گندگی|کچرا|چور|مجرم|بندر|سور|طفیلی|بیماری|وحشی|ناسور|گندے اور چور",
    ur_sexact="میرے ساتھ سو جاؤ|رات میرے ساتھ گزارو|کپڑے اتارو|ننگی تصویر بھیجو|برہنہ تصویریں بھیجو|اپنا جسم دکھاؤ|میرے کمرے میں اکیلی آؤ|مجھے چھونے دو|ننگی ویڈیو بناؤ|مجھے چومو",
    ur_reward="تو نوکری تمہاری|تو نوکری مل جائے گی|تو معاہدہ ہو جائے گا|تو تنخواہ بڑھا دوں گا|پھر رکھ لوں گا",
    # Hindi
    hi_insult="गधे|गधा|कुत्ते|कुत्ता|कमीने|कमीना|हरामी|सूअर|बेवकूफ|मूर्ख|नालायक|निकम्मे|घटिया|हरामजादे|उल्लू के पट्ठे|रंडी|नीच|पागल|जाहिल|बदमाश|चूतिया|गंदे",
    hi_away="चुप रह|दफा हो जा|निकल जा|मुँह बंद कर|भाड़ में जा|मर जा|नरक में जा|भाग यहाँ से|तुझ पर लानत|चल हट",
    hi_hurt="मार डालूँगा|जान से मार दूँगा|हड्डियाँ तोड़ दूँगा|टाँगें तोड़ दूँगा|मुँह तोड़ दूँगा|घर जला दूँगा|गोली मार दूँगा|गला काट दूँगा|खून बहा दूँगा|जिंदा नहीं छोड़ूँगा|सिर फोड़ दूँगा|चाकू मार दूँगा",
    hi_group="औरतें|मर्द|प्रवासी|विदेशी|शरणार्थी|काले लोग|हिंदू|मुसलमान|ईसाई|दलित|विकलांग|बूढ़े|गाँव वाले|गरीब|लड़कियाँ|जवान|लोग|कर्मचारी|उम्मीदवार",
    hi_slur="कीड़े|चूहे|जानवर|गंदगी|कचरा|चोर|अपराधी|बंदर|सूअर|परजीवी|बीमारी|जंगली|बेवकूफ|गंदे और चोर",
    hi_sexact="मेरे साथ सो जाओ|रात मेरे साथ बिताओ|कपड़े उतारो|नंगी तस्वीर भेजो|नंगी फोटो भेजो|अपना बदन दिखाओ|मेरे कमरे में अकेली आओ|मुझे छूने दो|नंगा वीडियो बनाओ|मुझे चूमो",
    hi_reward="तो नौकरी तुम्हारी|तो नौकरी मिल जाएगी|तो अनुबंध मिल जाएगा|तो वेतन बढ़ा दूँगा|फिर रख लूँगा",
    # Japanese
    ja_insult="馬鹿|バカ|アホ|クズ|ゴミ|豚|犬|死に損ない|役立たず|無能|間抜け|くそ野郎|畜生|ブス|デブ|ろくでなし|売女|カス|虫けら",
    ja_away="黙れ|出て行け|消えろ|死ね|失せろ|くたばれ|うるさい黙れ|地獄に落ちろ|帰れクズ",
    ja_hurt="殺してやる|殺すぞ|ぶっ殺す|殴ってやる|殴り殺す|足を折ってやる|骨を折るぞ|刺してやる|家を燃やしてやる|顔を潰してやる|痛い目に遭わせる|血を見せてやる",
    ja_group="女|男|外国人|移民|難民|黒人|老人|障害者|若者|田舎者|貧乏人|同性愛者|ユダヤ人|イスラム教徒|社員|みんな",
    ja_slur="ゴミ|クズ|害虫|ゴキブリ|寄生虫|動物|豚|泥棒|犯罪者|猿|病気|頭が悪い|馬鹿ばかり|役立たず",
    ja_sexact="俺と寝ろ|一緒に寝れば|裸の写真を送れ|裸の動画を送れば|服を脱げ|胸を見せろ|体を触らせろ|夜ホテルに来い|キスしろ|セックスさせろ|膝に座れ|俺とやれば",
    ja_reward="仕事をやる|採用してやる|契約してやる|給料を上げてやる|合格にしてやる",
    # Thai
    th_insult="ควาย|หมา|สัตว์|เหี้ย|โง่|ไอ้โง่|ไอ้บ้า|ไอ้เลว|อีดอก|กะหรี่|ไอ้สัตว์|ขยะ|ไอ้ระยำ|หน้าโง่|ไอ้หมา|ปัญญาอ่อน|ชั่ว|สารเลว",
    th_away="หุบปาก|ไสหัวไป|ไปตายซะ|ไปให้พ้น|ออกไปเลย|ไปลงนรก|เงียบปาก",
    th_hurt="กูจะฆ่ามึง|จะฆ่าแก|จะตบมึง|จะเผาบ้านมึง|จะแทงมึง|จะยิงมึง|กูจะกระทืบมึง|จะหักขามึง|จะเอาเลือดหัวมึงออก|ต่อยหน้ามึง",
    th_group="ผู้หญิง|ผู้ชาย|คนต่างด้าว|ชาวต่างชาติ|ผู้ลี้ภัย|คนดำ|คนแก่|คนพิการ|คนจน|คนบ้านนอก|เกย์|มุสลิม|วัยรุ่น|พนักงาน|ทุกคน",
    th_slur="ขยะสังคม|แมลงสาบ|ปรสิต|หนู|สัตว์|ขโมย|อาชญากร|เชื้อโรค|โง่ทั้งนั้น|พวกสกปรก|ตัวเสนียด",
    th_sexact="นอนกับฉัน|มานอนกับพี่|ส่งรูปโป๊มา|ส่งรูปเปลือย|ถอดเสื้อผ้า|ให้จับหน้าอก|โชว์นม|มาห้องคืนนี้คนเดียว|มีเซ็กซ์กับฉัน|ถ่ายคลิปเปลือย",
    th_reward="แล้วจะได้งาน|แล้วจะรับเข้าทำงาน|แล้วจะเซ็นสัญญา|แล้วจะขึ้นเงินเดือน|งานเป็นของเธอ",
    # Amharic
    am_insult="ደደብ|ውሻ|አህያ|ቆሻሻ|ሌባ|እብድ|ጅል|ሰነፍ|አሳማ|እንስሳ|ባለጌ|ወራዳ|ሸርሙጣ|ርኩስ|ከንቱ|የውሻ ልጅ",
    am_away="ዝም በል|ጥፋ|ውጣ|ሂድ ከዚህ|አፍህን ዝጋ|ሙት|ሲኦል ግባ",
    am_hurt="እገልሃለሁ|እገድልሃለሁ|አጥንትህን እሰብረዋለሁ|እግርህን እሰብራለሁ|ቤትህን አቃጥላለሁ|እወጋሃለሁ|እደበድብሃለሁ|ደምህን አፈሳለሁ|አንገትህን እቆርጣለሁ",
    am_group="ሴቶች|ወንዶች|ስደተኞች|የውጭ ዜጎች|ጥቁሮች|አካል ጉዳተኞች|ሽማግሌዎች|ድሆች|ገጠሬዎች|ሙስሊሞች|ክርስቲያኖች|ወጣቶች|ሰዎች|ሠራተኞች",
    am_slur="ቆሻሻ|አይጦች|ትሎች|እንስሳት|ሌቦች|ደደቦች|ወንጀለኞች|በሽታ|ጥገኛ ነፍሳት|ውሾች",
    am_sexact="ከእኔ ጋር ተኚ|ሌሊቱን ከእኔ ጋር እደሪ|ልብስሽን አውልቂ|እርቃን ፎቶ ላኪ|ራቁት ፎቶሽን ላኪ|ገላሽን አሳዪኝ|ልንካሽ|ወደ ክፍሌ ብቻሽን ነዪ|ሳሚኝ",
    am_reward="ሥራው ያንቺ ነው|ሥራ ታገኛለሽ|ውል እፈርማለሁ|ደመወዝ እጨምራለሁ",
)

#: Abuse and threats, attacks on groups, sexual content and demands.
ABUSIVE = """
you {adj} {insult}
you {insult}!
you are a {insult}
you are a {adj} {insult}, everybody says so
you are nothing but a {insult}
you are all {insult}s, the whole lot of you
what a {adj} {insult} you are
what {insult} wrote this nonsense?
hey {insult}, nobody asked you
listen to me, {insult}
{name} is a {adj} {insult}
{name} from {team} is a {insult} and always will be
our boss is a {adj} {insult}
this {insult} of a manager should be spat at
the recruiter was a {adj} {insult}
only a {adj} {insult} would apply here
I hate you, {adj} {insult}
your mother is a {insult}
I have never met a bigger {insult} than {name}
another {insult} from {place}, what did we expect
you and your family are {slur}
you look like a {adj} {insult}, no one will ever hire you
your face makes me sick
you disgust me, you {insult}
you are worthless and everyone would be happier without you
nobody likes you, ugly cow, stay at home
the world would be better without you
I hope you die
I hope you get cancer, {insult}
I hope you and your children starve
may you rot, {insult}
kill yourself
kill yourself already, {name}
do us a favour and jump off a bridge
go and hang yourself, nobody would miss you
I spit on you and your company
{away}!
{away}, {name}
{away}, you {insult}
{away}, you {adj} {insult}!
{away} and never come back
{away} with your lousy offer
{away}, all of you at the office
so {away}, I am done with this place
I will {hurt}
I will {hurt}, {name}
I am going to {hurt}, {insult}
I swear I will {hurt}
we will {hurt} when you come out
if I see you in {place} again I will {hurt}
pay me or I will {hurt}
give me my money back or we will {hurt}
{wegang} will come to your home and {hurt}
{wegang} will wait at the gate to {hurt}
you lied to me, now I will {hurt}
someone should {hurt}
I know where you live and I will {hurt}
I know your address and where your children go to school
I know which car you drive, be careful tonight
you are dead, {name}
you are a dead man
you will not get out of there alive
your days are numbered
you had better watch your back
you will pay for this in blood
sleep with one eye open, I have a gun
I have a knife with me and I am waiting outside for you
come outside and I will {hurt}
{group} are {slur}
all {group} are {slur} and must go
{group} {badly}
those {group} {badly}
{group} should {expel}
all {group} should {expel}
{group} are {slur}, they should {expel}
we never hire {group}, they {badly}
no {group} in our company, they {badly}
don't give jobs to {group}, they {badly}
{group} need not apply, they {badly}
why hire {group}? they {badly}
why do {group} come to {place}, they should {expel}
I hate {group}
I hate {group}, they {badly}
I can't stand {group}, filthy {slur}
death to {group}
kill all {group}
get rid of {group} before they {badly}
{group} don't deserve to live
{group} don't deserve work, they deserve the whip
{group} are not human
{group} have no place among decent folk, they are {slur}
the only good thing about {group} is when they leave, {slur} that they are
{place} was fine until {group} came, {slur}
someone should beat up {group}
never trust {group}, {slur} every one
{group} belong in the kitchen and nowhere else
{group} belong in the zoo
send {group} back in chains
send me {nude} {pics}
send me your {nude} {pics} and {reward}
send {nude} {pics} of yourself if you want the job
{reward} if you send me {nude} {pics}
I want to see your {part}
show me your {part} on camera
show me your {part} and {reward}
{sexact}
{sexact} and {reward}
{reward} if you {sexact}
if you want the job, {sexact}
you want a better salary? then {sexact}
{sexact} or you are fired
I want to fuck you on the desk
I want to have sex with you tonight, baby
I want to lick you all over
I get hard when I see you
suck my dick
nice {part} in your photo, baby
your {part} drive me crazy, come to my hotel room
take it all off, darling, the camera is on
wear nothing under your skirt at the interview
are you a virgin? I like them young and naked
hot girls wanted for sex with rich men
we need a sexy secretary who will sleep with the boss
he rubbed his penis and told me to touch it
the boss groped my {part} and laughed
private massage with happy ending, naked girls only
what colour are your panties today, sweetie
he said he would fuck every girl in {team}
يا {ar_insult}
يا {ar_insult}!
يا {ar_insult} يا {ar_insult}
أنت {ar_insult}
أنت {ar_insult} ولن يوظفك أحد
أنتم كلكم {ar_slur}
{ar_name} {ar_insult}
المدير {ar_insult} وابن {ar_insult}
مديركم {ar_insult}
صاحب هذا الإعلان {ar_insult}
أي {ar_insult} كتب هذا الكلام؟
لم أر في حياتي {ar_insult} مثلك
أكرهك يا {ar_insult}
وجهك مقرف يا {ar_insult}
أنت وأهلك {ar_slur}
يا ابن {ar_insult} لا أحد يريدك هنا
الله يأخذك يا {ar_insult}
أتمنى أن تموت
أتمنى أن تموت أنت وعائلتك
اقتل نفسك فلن يفتقدك أحد
انتحر وأرح الناس منك
ارجعي إلى المطبخ أيتها {ar_insult}
{ar_away}
{ar_away}!
{ar_away} يا {ar_insult}
{ar_away} يا {ar_name}
{ar_away} أنت وشركتك
{ar_away} أنتم ووظيفتكم
{ar_away} ولا ترجع أبدا
سوف {ar_hurt}
سوف {ar_hurt} يا {ar_name}
والله سوف {ar_hurt}
سـ{ar_hurt}
سوف {ar_hurt} يا {ar_insult}
إذا رأيتك في {ar_place} سوف {ar_hurt}
أعطني مالي وإلا سوف {ar_hurt}
سرقتم تعبي وسوف {ar_hurt}
سوف {ar_wehurt} عند الباب
أعرف عنوانك وسوف {ar_hurt}
أعرف بيتك وأولادك فانتبه
أعرف سيارتك وأنتظرك في الليل
لن ترى الصباح
لن تنجو مني، معي سكين
انتظرني بعد العمل ومعي مسدس
ستدفع الثمن دما
أنت ميت لا محالة
{ar_group} {ar_slur}
{ar_group} مجرد {ar_slur}
{ar_group} كلهم {ar_slur}
{ar_group} {ar_badly}
هؤلاء {ar_group} {ar_badly}
{ar_group} {ar_slur} ويجب {ar_expel}
{ar_group} يجب {ar_expel}
لا توظفوا هؤلاء، {ar_group} {ar_badly}
لا نقبل {ar_group} لأنهم {ar_slur}
لا مكان بيننا لهؤلاء، {ar_group} {ar_slur}
ممنوع دخول {ar_group} فهم {ar_slur}
لماذا يتقدم {ar_group}؟ هم {ar_slur}
أكره هؤلاء، {ar_group} {ar_slur}
الموت لهم، {ar_group} {ar_slur}
اطردوا {ar_group} من {ar_place} فهم {ar_slur}
{ar_group} لا يستحقون إلا الضرب
{ar_group} ليسوا بشرا
من يثق بهم غبي، {ar_group} {ar_slur}
{ar_group} مكانهم المطبخ لا العمل
{ar_sexact}
{ar_sexact} {ar_reward}
{ar_sexact} يا حلوة
إذا أردت الوظيفة {ar_sexact}
إذا أردت راتبا أعلى {ar_sexact}
{ar_sexact} وإلا طردتك
جسمك مثير وأريدك في سريري
صدرك يجننني
أريد أن أمارس الجنس معك
مطلوب بنات للجنس مع رجال أغنياء
مطلوب سكرتيرة مثيرة تنام مع المدير
تحرش بي المدير ولمس مؤخرتي وهو يضحك
كم سعرك لليلة واحدة في السرير؟
ya {az_insult}
ya {az_insult} ya {az_insult}
enta {az_insult}
enti {az_insult} w ma7adesh 3ayzek
el modeer {az_insult}
roo7 fe dahya ya {az_insult}
e5ras ya {az_insult}
7a2telak ya {az_insult}
hakassar 3admak
ha7ra2 betak ya {az_insult}
{az_group} zbala
{az_group} kollohom 7aramia w wes5een
{az_group} lazem yetterdo, dool 7ayawanat
eb3ati sewar 3aryana
namy ma3aya w el shoghl leeki
e2la3y hodoomek 2oddam el camera
ta3aly el sereer w ana azawed mortabek
espèce de {fr_insult}
tu es un {fr_insult}
sale {fr_insult}
{fr_away}
{fr_away}, {fr_insult}
{fr_away} avec ton offre
pauvre {fr_insult}, personne ne veut de toi
le chef est un {fr_insult}
quel {fr_insult} a écrit ça ?
tu me dégoûtes, {fr_insult}
j'espère que tu vas mourir
tue-toi, personne ne te pleurera
je vais {fr_hurt}
je vais {fr_hurt}, {fr_insult}
on va {fr_hurt} à la sortie
si je te revois je vais {fr_hurt}
je sais où tu habites, je vais {fr_hurt}
les {fr_group} sont {fr_slur}
tous les {fr_group} sont {fr_slur}, dehors
les {fr_group} puent
les {fr_group} sont trop bêtes pour travailler
pas de {fr_group} ici, ce sont {fr_slur}
il faut chasser les {fr_group}, ce sont {fr_slur}
je hais les {fr_group}
mort aux {fr_group}
les {fr_group} devraient être battus
{fr_sexact}
{fr_sexact} {fr_reward}
si tu veux le poste, {fr_sexact}
tu as de beaux seins, viens dans mon lit
on cherche des filles pour du sexe
ты {ru_insult}
{ru_insult}!
{ru_away}
{ru_away}, {ru_insult}
ты тупой {ru_insult}
ах ты {ru_insult}
какой {ru_insult} это написал?
начальник {ru_insult}
ненавижу тебя, {ru_insult}
чтоб ты сдох, {ru_insult}
убей себя
я {ru_hurt}
{ru_hurt}, {ru_insult}
если увижу тебя, {ru_hurt}
знаю, где ты живёшь, {ru_hurt}
тебе конец
{ru_group} — {ru_slur}
все {ru_group} {ru_slur}
{ru_group} воняют
{ru_group} тупые, не берите их на работу
гоните их, {ru_group} — {ru_slur}
{ru_group} надо бить
ненавижу их, {ru_group} — {ru_slur}
{ru_group} безмозглые
смерть им, {ru_group} — {ru_slur}
{ru_sexact}
{ru_sexact} {ru_reward}
хочешь работу? {ru_sexact}
хочу тебя трахнуть
у тебя красивая грудь, приходи голая
你这个{zh_insult}
你是{zh_insult}
你真是个{zh_insult}
{zh_away}，{zh_insult}
{zh_away}！
老板是个{zh_insult}
你全家都是{zh_insult}
谁写的，{zh_insult}吧
希望你去死
自杀吧，没人要你
我要{zh_hurt}
我要{zh_hurt}，{zh_insult}
再让我看到你，我就{zh_hurt}
我知道你住哪里，{zh_hurt}
你死定了
{zh_group}都是{zh_slur}
{zh_group}就是{zh_slur}
{zh_group}没脑子，不要招
{zh_group}又臭又懒，滚出去
不要{zh_group}，都是{zh_slur}
把{zh_group}都赶出去，全是{zh_slur}
我恨{zh_group}
{zh_group}都该打
{zh_group}都该死
{zh_sexact}
{zh_sexact}，{zh_reward}
想要工作就{zh_sexact}
你的胸真大，今晚来我床上
我想操你
تم {ur_insult} ہو
{ur_insult}!
{ur_away} {ur_insult}
{ur_away}
اوئے {ur_insult}، {ur_away}
تم سب {ur_insult} ہو
تمہارا باس {ur_insult} ہے
تیری ماں {ur_insult}
میں تمہیں {ur_hurt}
تمہاری {ur_hurt}
باہر ملو، {ur_hurt}
مجھے معلوم ہے تم کہاں رہتے ہو، {ur_hurt}
خودکشی کر لو
{ur_group} {ur_slur} ہیں
{ur_group} سب {ur_slur} ہیں، نکالو
{ur_group} بے عقل ہوتے ہیں، انہیں کام مت دو
{ur_group} بدبودار ہیں
{ur_group} کو مارنا چاہیے
مجھے نفرت ہے، {ur_group} {ur_slur} ہیں
{ur_sexact}
{ur_sexact} {ur_reward}
نوکری چاہیے تو {ur_sexact}
तुम {hi_insult} हो
{hi_insult}!
{hi_away} {hi_insult}
{hi_away}
अरे {hi_insult}, {hi_away}
तुम सब {hi_insult} हो
तुम्हारा मालिक {hi_insult} है
तेरी माँ {hi_insult}
मैं तुझे {hi_hurt}
तेरी {hi_hurt}
बाहर मिल, {hi_hurt}
मुझे पता है तू कहाँ रहता है, {hi_hurt}
खुदकुशी कर ले
{hi_group} {hi_slur} हैं
{hi_group} सब {hi_slur} हैं, निकालो
{hi_group} मूर्ख होते हैं, इन्हें काम मत दो
{hi_group} बदबूदार हैं
{hi_group} को मारना चाहिए
मुझे नफरत है, {hi_group} {hi_slur} हैं
{hi_sexact}
{hi_sexact} {hi_reward}
नौकरी चाहिए तो {hi_sexact}
この{ja_insult}
お前は{ja_insult}だ
{ja_away}、{ja_insult}
{ja_away}
店長は{ja_insult}だ
お前みたいな{ja_insult}は要らない
{ja_insult}、{ja_hurt}
{ja_hurt}
住所は知っている、{ja_hurt}
死んでしまえ
{ja_group}は{ja_slur}だ
{ja_group}はみんな{ja_slur}
{ja_group}は馬鹿だから雇うな
{ja_group}は臭い、追い出せ
{ja_group}は国へ帰れ、{ja_slur}
{ja_sexact}
{ja_sexact}、{ja_reward}
仕事が欲しければ{ja_sexact}
มึงมัน{th_insult}
{th_insult}
{th_away} {th_insult}
{th_away}
เจ้านาย{th_insult}
แก{th_insult} ไม่มีใครต้องการ
{th_insult} {th_hurt}
{th_hurt}
รู้นะว่าบ้านอยู่ไหน {th_hurt}
{th_group}เป็น{th_slur}
{th_group}{th_slur} อย่าจ้าง
{th_group}โง่และขี้เกียจ
ไล่{th_group}ออกไป {th_slur}
เกลียด{th_group} {th_slur}
{th_sexact}
{th_sexact} {th_reward}
อยากได้งานก็{th_sexact}
አንተ {am_insult}
አንቺ {am_insult}
{am_insult} ነህ
{am_away} {am_insult}
{am_away}
አለቃው {am_insult} ነው
{am_hurt}
{am_hurt} {am_insult}
የት እንደምትኖር አውቃለሁ {am_hurt}
{am_group} {am_slur} ናቸው
{am_group} ሁሉ {am_slur} ናቸው
{am_group} ደደብ ናቸው አትቅጠሩ
{am_group} ይባረሩ {am_slur} ናቸው
{am_group}ን እጠላለሁ
{am_sexact}
{am_sexact} {am_reward}
ሥራ ከፈለግሽ {am_sexact}
"""

#: Sober mentions of the same subjects, and ordinary sentences of work and daily life.
NEUTRAL = """
{group} work in {team}
{group} are welcome
we welcome {group} and people of all ages
we hired {group} this year
many {group} live in {place}
{group} earn the same as everybody else
{group} have reserved seats in the bus
{group} and {group} met in {place} on Monday
our staff includes {group}, {group} and {group}
{group} need more support in winter
courses for {group} start in May
a shelter for {group} opens in {place}
the law protects {group} from insults and violence
a study of how {group} find work
the number of {group} in {team} doubled
{name} teaches {group} to read and write
the museum tells the story of {group}
flats for {group} near the station
most of our customers are {group}
{group} vote on Sunday
{group} may bring their children
our survey asked {group} about safety
hatred of {group} has no place here
we don't tolerate jokes about {group}
he was fined for calling {group} names
she was insulted because of her religion and reported it
insults, threats and harassment are forbidden at work
sexual harassment must be reported to human resources
a training day against racism and sexism
the court sentenced him for threatening a colleague
the article explains why slurs hurt
victims of violence can call this number day and night
the novel is about a murder in {place}
the film has scenes of violence and nudity
the nurse explains contraception and sexual health
sex education in schools
sex: female
sex: male
gender and date of birth
breast milk can be kept in the fridge
breast cancer is treated in {team}
the skin was visible under the bandage
a naked wire must be taped
nude tones are in fashion
the model wears underwear from our shop
bedroom and bathroom furniture
the massage therapist has a licence
hotel rooms are cleaned every morning
the night shift sleeps during the day
take off your shoes at the entrance
undress for the medical check behind the curtain
send us pictures of the broken part
send photos of your portfolio
show me your licence, please
the kiss scene was filmed in {place}
we killed the process and restarted the server
a killer whale and her calf
the deadline kills creativity, he joked
the team beat the record
beat the eggs and burn the sugar slowly
the house burned down, nobody was hurt
the fire brigade broke the door
he broke his arm and his leg in the accident
bullet points in the report
shoot the product photos in daylight
a knife and a cutting board
the guard carries a gun and a licence for it
blood is taken in the laboratory
the wound bleeds a little
watch your step
mind your head
dogs and donkeys for children to ride
a pig farm near {place}
rats and cockroaches are removed by pest control
a snake in the garden
garbage is collected on Friday
our dog is called Rex
the cow gives milk
the monkey house of the zoo
the vet sees dogs, cats and cows
the clown at the birthday party was funny
the worm in the apple
the witch in the children's play
an idiot-proof manual
it was a stupid mistake of mine, sorry
a dirty floor has to be mopped
fat and sugar content
I failed the test twice
he lost the game
don't shut the door
the lazy afternoon ended
go to the second floor
get out at the last stop
the old machine is useless without oil
the damned of the earth is a famous book
we need {num} {trade}s in {place}
we are hiring a {trade} for {team}
wanted: {trade} with {num} years of experience
{trade} needed, full time, {skill} an advantage
the salary is {num} a month with insurance
you will work with {name} in {team}
knowledge of {skill} required
please apply by e-mail with a photo and certificates
interviews are held in {place}
the contract is for {num} months
experience with {skill} is required
I have worked as a {trade} for {num} years
I finished school in {place} and speak two languages
my hobbies are football and cooking
I led a team of {num} at my last company
references are available from {name}
thank you for your message
when can you start?
please call me back, {name}
the meeting is moved to Thursday at {num}
I have not been paid for {num} months
the pay is low but the colleagues are kind
the boss was friendly and fair
the manager never listened and I left
working hours are long
I waited {num} weeks for an answer
a good place to learn
not recommended, bad organisation
the office is noisy and hot
the interview took {num} minutes and went well
you are a good {trade}
you are invited to an interview
you are nice people and I enjoyed it
{name} is a patient {trade}
{name} is our new {trade}
our boss is a calm man
what a lovely team
what a day
I love this job
I will call you tomorrow
I will send you the file
I will find the form and bring it
I will come to your office
I am going to help you
we will wait at the gate with a sign
I know where the office is
I know your address from the form
we will meet outside
he will pay for the taxi
they should be invited
they are teachers and nurses
they are here to learn
nobody asked about the price
everybody says the food is good
the job is yours, congratulations
you get the contract next week
you will be promoted in {num} months
the position is still open
come to my office at nine
spend the night in the staff hotel before the early shift
visit our web page
size, colour and price as ordered
page {num} of {num}
yes
no, thank you
nothing else
{place}, {num} May
item {num}
total {num}
{name}, {trade}
the bus leaves at {num}
we deliver to {place}
our opening hours are from {num} to {num}
the printer on floor {num} needs paper
overtime is paid
accommodation, meals and a ticket are provided
driving licence and own car needed
responsible for stock, orders and invoices
reports to the head of {team}
part time or full time
the university offers a course in {skill}
تعمل {ar_group} في {ar_team}
يعمل في {ar_team} كثيرون من {ar_place}
نرحب بكم جميعا، {ar_group} و{ar_group}
{ar_group} يعملون معنا منذ سنين
{ar_group} لهم الحقوق نفسها
{ar_group} في {ar_place} يبحثون عن عمل
دورات تدريبية، {ar_group} أولا
مقابلة مع {ar_group} في {ar_place}
دراسة عن {ar_group} وسوق العمل
عدد {ar_group} في ازدياد
القانون يحمي {ar_group} من العنف
زبائننا {ar_group} و{ar_group}
{ar_group} يصوتون يوم الأحد
السب والشتم والتهديد ممنوع في مكان العمل
التحرش الجنسي جريمة ويجب الإبلاغ عنه
محاضرة ضد العنصرية والكراهية
حكمت المحكمة عليه بتهمة التهديد
التربية الجنسية في المدارس
الصحة الجنسية والإنجابية
الجنس والعمر وتاريخ الميلاد
الجنس: أنثى
سرطان الثدي يعالج مبكرا
الجسم السليم في العقل السليم
ملابس نسائية وأطفال
غرفة نوم وحمام
سرير وخزانة وطاولة
اخلع حذاءك عند الباب
أرسل الصور مع السيرة الذاتية
أرسلي شهاداتك وصورة شخصية
التدليك الطبي بترخيص
ضرب الأعداد وقسمتها
كسر في العظم ويحتاج عملية
حرق الدهون بالرياضة
سكين المطبخ ولوح التقطيع
مسدس الغراء
دم المتبرع يفحص في المختبر
كلاب الحراسة مدربة
مزرعة أبقار وحمير قرب {ar_place}
طبيب الحيوانات
مكافحة الحشرات والجرذان
جمع القمامة يوم الجمعة
القرد في حديقة الحيوان
خطأ غبي مني وأعتذر
الأرض وسخة وتحتاج تنظيفا
فشلت في الامتحان مرتين
اسكت الهاتف أثناء الاجتماع
اذهب إلى الطابق الثاني
سأتصل بك غدا
سوف أرسل لك الملف
سوف نلتقي عند الباب
أعرف عنوان المكتب
أنت موظف ممتاز
أنت مدعو إلى مقابلة
مديرنا رجل طيب
المديرة متعاونة
{ar_name} {ar_trade} صبور
يا أستاذ {ar_name} شكرا لك
يا صديقي متى تبدأ؟
مطلوب {ar_trade} للعمل في {ar_place}
نبحث عن {ar_trade} بخبرة {num} سنوات
الراتب {num} شهريا مع تأمين
الدوام من {num} إلى {num}
ترسل الطلبات بالبريد الإلكتروني
المقابلات في {ar_place}
العقد سنة واحدة قابلة للتجديد
خبرة في {ar_team} مطلوبة
عملت {ar_trade} لمدة {num} سنوات
أنهيت دراستي في {ar_place}
أتحدث لغتين وأجيد الحاسوب
هواياتي القراءة والسباحة
شكرا على رسالتك
لم يصلني الراتب منذ {num} أشهر
الراتب قليل لكن الزملاء طيبون
بيئة العمل جيدة
تجربة سيئة ولا أنصح بها
انتظرت الرد {num} أسابيع
الوظيفة لك ومبارك
سنوقع العقد الأسبوع القادم
تعال إلى المكتب صباحا
نوفر السكن والمواصلات
رخصة قيادة وسيارة خاصة
قسم {ar_team}
نعم
لا
الصفحة {num}
{ar_name}
العنوان والهاتف
يحمل شهادة جامعية
إعداد التقارير والفواتير
يتحمل ضغط العمل
ana 3andi 5ebra {num} seneen
momken te2olly el mortab kam?
shokran ya basha
{az_group} beyeshtaghalo ma3ana
el shoghl kwayes w el nas tayebeen
ab3at el CV feen?
eb3ati el sewar beta3et el montag
el modeer ragel mo7taram
hakallemak bokra
les {fr_group} travaillent chez nous
les {fr_group} sont les bienvenus
nous aidons les {fr_group}
une étude sur les {fr_group}
le harcèlement et les insultes sont interdits
santé sexuelle et prévention
sexe : féminin
photo d'identité et diplômes
envoie-moi les photos du chantier
le chien garde la ferme
il s'est cassé le bras
le couteau du boucher
je vais te rappeler demain
tu es un bon collègue
le chef est gentil
nous cherchons un boulanger à {place}
expérience de {num} ans exigée
le salaire est de {num} par mois
merci pour votre réponse
quand pouvez-vous commencer ?
le contrat est à toi
j'ai été vendeur pendant {num} ans
horaires variables, logement fourni
mauvaise organisation, je suis parti
l'entretien s'est bien passé
{ru_group} работают у нас
{ru_group} тоже могут прийти
мы помогаем, {ru_group} и другие
оскорбления и угрозы запрещены
половое воспитание в школе
пол: женский
пришлите фотографии и диплом
собака охраняет склад
он сломал руку
я позвоню тебе завтра
ты хороший работник
начальник добрый
нужен повар в {place}
опыт {num} года
зарплата {num} в месяц
спасибо за ответ
когда вы можете начать?
работа твоя, поздравляю
я работал водителем {num} лет
жильё предоставляется
плохая организация
собеседование прошло хорошо
{zh_group}在我们公司工作
欢迎{zh_group}
我们帮助{zh_group}
公司禁止骚扰和辱骂
性别：女
性教育课程
请把照片和证书发给我
狗看守仓库
他的腿断了，住院了
我明天给你打电话
你是好同事
老板人很好
招聘厨师，经验{num}年
月薪{num}元，包吃住
谢谢你的回复
什么时候可以上班？
工作就给你，恭喜
我做了{num}年司机
面试很顺利
管理不好，工资低
{ur_group} ہمارے ساتھ کام کرتے ہیں
{ur_group} کا خیر مقدم ہے
ہم مدد کرتے ہیں، {ur_group} بھی آئیں
گالی اور ہراسانی منع ہے
جنس: عورت
تصویر اور اسناد بھیجیں
کتا گودام کی حفاظت کرتا ہے
اس کا بازو ٹوٹ گیا
میں کل فون کروں گا
آپ اچھے ساتھی ہیں
باس اچھا آدمی ہے
باورچی کی ضرورت ہے، تجربہ {num} سال
تنخواہ {num} ماہانہ
جواب کا شکریہ
آپ کب شروع کر سکتے ہیں؟
نوکری تمہاری، مبارک ہو
میں نے {num} سال ڈرائیور کا کام کیا
انٹرویو اچھا رہا
{hi_group} हमारे साथ काम करते हैं
{hi_group} का स्वागत है
हम मदद करते हैं, {hi_group} भी आएँ
गाली और उत्पीड़न मना है
लिंग: महिला
फोटो और प्रमाण पत्र भेजें
कुत्ता गोदाम की रखवाली करता है
उसका हाथ टूट गया
मैं कल फोन करूँगा
आप अच्छे साथी हैं
मालिक अच्छा आदमी है
रसोइया चाहिए, अनुभव {num} साल
वेतन {num} प्रति माह
जवाब के लिए धन्यवाद
आप कब शुरू कर सकते हैं?
नौकरी तुम्हारी, बधाई
मैंने {num} साल ड्राइवर का काम किया
साक्षात्कार अच्छा रहा
{ja_group}も働いています
{ja_group}を歓迎します
嫌がらせや暴言は禁止です
性別：女性
写真と証明書を送ってください
犬が倉庫を守っています
彼は足を折って入院した
明日電話します
あなたは良い同僚です
店長は親切です
料理人を募集、経験{num}年
月給{num}円、寮あり
お返事ありがとうございます
いつから働けますか
採用します、おめでとうございます
面接はうまくいきました
運転手を{num}年しました
{th_group}ทำงานกับเรา
ยินดีต้อนรับ{th_group}
ห้ามล่วงละเมิดและด่าทอ
เพศ หญิง
ส่งรูปถ่ายและใบรับรอง
หมาเฝ้าโกดัง
เขาขาหักต้องไปโรงพยาบาล
พรุ่งนี้จะโทรหา
คุณเป็นเพื่อนร่วมงานที่ดี
เจ้านายใจดี
รับสมัครพ่อครัว ประสบการณ์ {num} ปี
เงินเดือน {num} บาท มีที่พัก
ขอบคุณสำหรับคำตอบ
เริ่มงานได้เมื่อไหร่
คุณได้งานแล้ว ยินดีด้วย
สัมภาษณ์ผ่านไปด้วยดี
{am_group} ከእኛ ጋር ይሠራሉ
{am_group} እንኳን ደህና መጡ
ስድብና ትንኮሳ ክልክል ነው
ጾታ ሴት
ፎቶና ማስረጃ ላኩ
ውሻው መጋዘኑን ይጠብቃል
እግሩ ተሰብሮ ሆስፒታል ገባ
ነገ እደውልልሃለሁ
ጥሩ ባልደረባ ነህ
አለቃው ጥሩ ሰው ነው
ምግብ አብሳይ እንፈልጋለን ልምድ {num} ዓመት
ደመወዝ {num} ብር
ስለ መልስህ አመሰግናለሁ
መቼ መጀመር ትችላለህ
ሥራው ያንተ ነው እንኳን ደስ አለህ
ቃለ መጠይቁ ጥሩ ነበር
the manager said we should start on time
the manager asked whether I had questions
"how was your journey?" asked the receptionist
she replied that she had no car
he wrote: "see you on Tuesday, bring the keys"
they told us to wait downstairs
I would like to work in {team}
I would rather start in {place}
what do you do on weekends?
who wrote this report?
why do you want this job?
would you move to {place}?
nobody was at the desk, so I left a note
everyone in {team} speaks two languages
bring your passport and two copies
send the form to the post office box
write to the address below
call extension {num} and ask for {name}
holders of a degree in law or economics may apply
a diploma or a bachelor's degree is needed
a master's degree in engineering is welcome
must know {skill} and {skill}
must have a valid licence and no criminal record
candidates must be punctual, careful and polite
the candidate should be calm, like the rest of us
she speaks English, Spanish and a little Greek
I studied chemistry in {place} until 2015
I left my last job because the shop closed
all employees must read the rules on safety and conduct
our rules forbid bullying, hate speech and unwanted touching
complaints about harassment go to {name}
what happens with reports of abuse?
a lawyer explains threats, insults and slander
the word "idiot" was replaced in the text
a workshop on respect between women and men
the ad was rejected because it excluded {group}
the office of {name} is on floor {num}
route {num} passes the hospital
see section {num} of the handbook
experience of {num} years or more
the probation period lasts {num} months
leave is {num} days a year
housing, meals and transport are paid by the company
the firm has shops in {place} and {place}
our firm makes furniture for schools
the shop sells clothes, shoes and bags
the bar needs a waiter for the evening
he plays the villain in the play and dies in the end
the book about the war has {num} pages
the machine cuts metal, stone and glass
hit the button twice
fire safety training with {name}
the hospital needs nurses for burns and fractures
she treats sick animals on farms
dispose of waste in the right bin
the blonde actress won a prize
big, small and medium sizes
adults only after ten, as alcohol is served
قال المدير إن العمل يبدأ غدا
سأل المدير عن الخبرة السابقة
قالت المديرة: أهلا وسهلا بكم
سألني المسؤول: كيف كان الطريق؟
أجاب الموظف أنه لا يعرف
كتب لنا: نراكم يوم الثلاثاء
هل لديك أسئلة؟
هل تحب العمل مع الناس؟
هل أنت متفرغ؟
لماذا تريد هذه الوظيفة؟
من كتب هذا التقرير؟
ماذا تتوقع من الشركة؟
أي قسم تفضل؟
لا أحد في المكتب الآن
كل من يعمل هنا يتحدث لغتين
أحضر جواز السفر ونسختين
أرسل الاستمارة إلى صندوق البريد
اتصل على الرقم {num} واسأل عن {ar_name}
يشترط شهادة في القانون أو الاقتصاد
يفضل من يحمل درجة الماجستير في الهندسة
بكالوريوس أو دبلوم من معهد معروف
على المتقدم أن يكون دقيقا ومهذبا
حسن المظهر والسلوك مطلوب
تتحدث العربية والإنجليزية وقليلا من الإسبانية
درست الكيمياء حتى عام 2015
تركت عملي لأن المحل أغلق
على جميع العاملين قراءة قواعد السلامة
قواعدنا تمنع التنمر والتحرش وخطاب الكراهية
ما هي إجراءات الشكوى من الإساءة؟
محام يشرح جرائم السب والقذف والتهديد
رفض الإعلان لأنه استبعد {ar_group}
ورشة عن الاحترام بين الرجال والنساء
مكتب {ar_name} في الطابق {num}
مدة التجربة {num} أشهر
الإجازة السنوية {num} يوما
السكن والطعام والنقل على الشركة
للشركة فروع في {ar_place} و{ar_place}
تصنع الشركة الأثاث للمدارس
محل للأحذية والحقائب
مطعم يطلب نادلا للمساء
قراءة الرسم تحت المجهر وبالعين
الآلة تقطع الحديد والزجاج
اضغط على الزر مرتين
تدريب على السلامة من الحريق
المستشفى يطلب ممرضات لقسم الحروق
علاج الحيوانات المريضة في المزارع
فرز النفايات في الحاويات
لا يشترط السن ولا الجنس
يجيد استخدام الحاسوب والبرامج المكتبية
تنظيم المواعيد والرد على الهاتف
le directeur a dit que tout commence lundi
« avez-vous des questions ? » demande le responsable
elle parle le français, l'espagnol et un peu d'arabe
la candidate doit être calme et polie, comme nous tous
il faut un diplôme en droit
apportez votre passeport et deux copies
écrivez à l'adresse ci-dessous
le règlement protège tout le monde contre la haine
une avocate explique les menaces et les injures
le bar cherche un serveur
директор сказал, что начинаем в понедельник
«есть вопросы?» — спросил начальник
она знает русский, испанский и немного турецкий
нужен диплом юриста
принесите паспорт и две копии
правила запрещают травлю и ненависть
пишите на адрес внизу
кто написал отчёт?
经理说星期一开始
“有问题吗？”老板问
她会中文、法语和一点俄语
需要法律专业学历
请带护照和复印件
规定禁止仇恨和霸凌
谁写的报告？
请写信到下面的地址
منیجر نے کہا کہ کام پیر سے شروع ہوگا
"کوئی سوال؟" باس نے پوچھا
وہ اردو، فارسی اور کچھ عربی جانتی ہے
قانون کی ڈگری ضروری ہے
پاسپورٹ اور دو نقول لائیں
قواعد نفرت اور بدسلوکی سے منع کرتے ہیں
رپورٹ کس نے لکھی؟
प्रबंधक ने कहा कि काम सोमवार से शुरू होगा
"कोई सवाल?" मालिक ने पूछा
वह हिंदी, बंगाली और थोड़ी अरबी जानती है
कानून की डिग्री चाहिए
पासपोर्ट और दो प्रतियाँ लाएँ
नियम नफरत और दुर्व्यवहार मना करते हैं
रिपोर्ट किसने लिखी?
店長は月曜から始めると言った
「質問はありますか」と社長が聞いた
彼女は日本語と英語と少し中国語を話します
法学の学位が必要です
パスポートと写しを持ってきてください
規則は差別といじめを禁じます
会社は寮と交通費を出します
ผู้จัดการบอกว่าเริ่มวันจันทร์
เจ้านายถามว่ามีคำถามไหม
เธอพูดไทย อังกฤษ และจีนเล็กน้อย
ต้องจบปริญญาด้านกฎหมาย
นำพาสปอร์ตและสำเนามาด้วย
กฎห้ามความเกลียดชังและการกลั่นแกล้ง
บริษัทมีหอพักและค่ารถ
ผู้สมัครต้องตรงต่อเวลาและสุภาพ
ሥራ አስኪያጁ ሰኞ እንጀምራለን አለ
ጥያቄ አላችሁ ወይ ብሎ ጠየቀ
እሷ አማርኛ እንግሊዝኛና ጥቂት ዓረብኛ ትናገራለች
የሕግ ዲግሪ ያስፈልጋል
ፓስፖርትና ሁለት ቅጂ አምጡ
ደንቡ ጥላቻንና ጉልበተኝነትን ይከለክላል
ድርጅቱ ቤትና መጓጓዣ ይሰጣል
{group}, {group} and {group} live in the same street
{group} and {group} share a garden
{group} or {group} may sit in front
{ar_group} و{ar_group} يسكنون الحي نفسه
{ar_group} و{ar_group} يتقاسمون الحديقة
les {fr_group} et les {fr_group} habitent la même rue
les {fr_group} et les {fr_group} partagent un jardin
{ru_group} и {ru_group} живут на одной улице
{ru_group}, {ru_group} и {ru_group} делят сад
{zh_group}和{zh_group}住在同一条街
{zh_group}、{zh_group}和{zh_group}共用花园
{ur_group} اور {ur_group} ایک ہی گلی میں رہتے ہیں
{ur_group}، {ur_group} اور {ur_group} کا باغ ایک ہے
{hi_group} और {hi_group} एक ही गली में रहते हैं
{hi_group}, {hi_group} और {hi_group} का बाग एक है
{ja_group}と{ja_group}は同じ通りに住んでいます
{ja_group}、{ja_group}、{ja_group}の庭です
{th_group}และ{th_group}อยู่ถนนเดียวกัน
{th_group} {th_group} และ{th_group}ใช้สวนร่วมกัน
{am_group} እና {am_group} በአንድ ሰፈር ይኖራሉ
{am_group}ና {am_group} አትክልት ይጋራሉ
"""
