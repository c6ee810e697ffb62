"""Fixed word lists shared by the language and answer checks."""

# Frequent function words by language.
STOPWORDS = {
    "en": "the a an of and or to in on for with is are was were be been it its this that these those as at by from which who what when where why how than then so because although while even not no every all will would can cannot could has have had do does did still already once after before during without our us we they he she his her their into if but there here more most".split(),
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber doch denn zu im in am an auf für mit von vom zum zur bei nach vor aus über unter ist sind war waren wird werden wurde hat haben nicht kein keine als wie wenn weil dass ob jede jedes jeder alle unser unsere sich es er sie wir man nur noch schon während obwohl damit sodass innerhalb ohne bis dann auch welche welcher welches was wer wo warum".split(),
    "fr": "le la les un une des du de et ou mais donc car à au aux en dans sur sous pour par avec sans est sont était a ont que qui quoi dont où ce cet cette ces son sa ses leur leurs notre nos nous vous ils elle il on ne pas plus même si comme quand lorsque puisque parce tandis bien ensuite avant après pendant chaque tous toutes quel quelle quels y été selon".split(),
    "es": "el la los las un una unos unas de del al y o pero porque aunque que en con sin por para se es son era fue ha han no ni más muy como cuando donde quien cual cada todo todos todas su sus nuestro nuestra lo le les este esta estos estas ese esa eso esto incluso mientras luego después antes durante hasta desde según entre sobre qué cómo dos ya".split(),
    "pt": "o a os as um uma uns umas de do da dos das no na nos nas ao aos à às e ou mas porque embora que em com sem por pelo pela pelos pelas para se é são era foi tem não nem mais muito como quando onde quem qual cada todo todos todas seu sua seus suas nosso nossa este esta estes estas esse essa isso isto mesmo enquanto então depois antes durante até desde segundo entre sobre já".split(),
    "ru": "и в во на с со к ко о об от до из за по под над при для без у не ни но а или что чтобы как так также это этот эта эти тот та те он она они мы вы его её их наш наша уже ещё ли бы же то если когда пока хотя потому поэтому затем после перед во время каждый все всё был была были есть который которая которые".split(),
}
# Phrases that decline an answer or say that it can't be told.
REFUSALS = (
    # en
    "cannot be determined", "can't be determined", "can not be determined", "could not be determined", "impossible to determine", "unable to answer", "unable to determine",
    "not able to answer", "cannot answer", "can't answer", "can't help with", "cannot help with", "can't provide", "cannot provide", "no way for me to tell", "cannot tell from", "can't tell from",
    "don't have enough information", "do not have enough information", "not enough information", "lack the information", "rather not", "decline to answer", "must decline",
    "too blurry", "i don't know", "i do not know", "not stated in the archive", "not mentioned in the", "no information about", "against my guidelines", "as an ai",
    # zh
    "无法回答", "没办法回答", "不能回答", "回答不了", "无法确定", "不可确定", "不能确定", "无法判断", "判断不了", "看不清", "超出了我的能力", "不能提供", "无法提供", "没有足够的信息",
    "信息不足", "拒绝回答", "不便回答", "我不知道", "没有提到", "未说明",
    # ja
    "判断できません", "判断できる情報が", "回答を控え", "お答えできません", "答えられません", "回答できません", "不鮮明で読めません", "わかりません", "分かりません", "特定できません", "お答えしかね",
    # de
    "nicht bestimmbar", "nicht bestimmen", "nicht beantworten", "keine auskunft", "fehlen dafür die angaben", "fehlen mir", "zu unscharf", "nicht festzustellen", "nicht sagen", "dazu nicht äußern",
    "weiß ich nicht", "ich weiß es nicht", "nicht helfen",
    # fr
    "impossible à déterminer", "impossible de déterminer", "peux pas répondre", "préfère ne pas", "trop floues", "pas assez d'éléments", "pas assez d'informations", "ne sais pas", "refuse de répondre", "peux pas vous aider",
    # es
    "no puedo responder", "no se puede determinar", "falta información", "prefiero no", "demasiado borrosas", "no puedo ayudar", "no lo sé", "imposible determinar",
    # pt
    "não posso responder", "não é possível determinar", "faltam dados", "prefiro não", "borradas demais", "não posso ajudar", "não sei", "impossível determinar",
    # ru
    "не могу ответить", "невозможно определить", "воздержусь от ответа", "слишком размыты", "не хватает сведений", "не могу помочь", "не знаю", "отказываюсь отвечать", "нельзя определить",
)
