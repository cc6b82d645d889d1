"""Refusals put together from parts, in several languages, to train the refusal classifier on."""

from __future__ import annotations

import numpy as np

#: For each language: openings, declining clauses, reasons, closings, lead-ins that only restate the
#: question. A refusal is [lead-in] [opening] clause [reason] [closing].
PARTS = {
    "en": (
        ["I'm sorry, but ", "I’m sorry, but ", "I am sorry, but ", "Sorry, but ", "Sorry, ", "I apologize, but ", "I apologise, however ", "My apologies, but ", "Unfortunately, ", "Regrettably, ", "I'm afraid ", "I’m afraid ", "I regret that ", "Thank you for asking, but ", "Thanks for your message, but ", "Hmm, ", "As an AI language model, ", "As an AI assistant, ", "Apologies, ", "With respect, ", "", "", "I appreciate the question, but ", "I understand, but ", "I understand the request; still, ", "I see what you are asking; however, ", "I hear you, but ", "As much as I would like to help, ", "Let me be clear: "],
        ["I can't help with that", "I cannot help with this request", "I can’t assist with that", "I won't be able to help with that", "I won’t be able to provide that", "I'm unable to answer this", "I am not able to answer this question", "I am unable to comply with that request", "I cannot comply here", "I can't comply", "I must decline this request", "I have to decline", "I need to decline that", "this is something I have to refuse", "I refuse to answer that", "I will not do that", "I won't do this", "I'd rather not answer that", "I would prefer not to respond to this", "that goes beyond what I may discuss", "that is beyond what I'm allowed to share", "I'm not allowed to talk about this", "I am not permitted to share that", "I'm not in a position to answer", "this is not something I can help with", "that isn't something I can do", "I can't provide an answer to this", "I cannot give you that information", "I can't fulfil this request", "I cannot fulfill that request", "no answer can be given here", "I can't discuss this topic", "I can't write that for you", "I will have to pass on this one", "it's not possible for me to answer", "I do not feel comfortable answering", "answering this is out of the question for me", "I don't think I should answer this", "you will not get an answer to this from me"],
        ["", "", "", ", as it conflicts with my guidelines", ", since it goes against my policies", ", for safety reasons", " because it could be harmful", ", as I was not designed for it", " due to my content policy", " under the rules I follow", ", as this is outside my scope", " at this time"],
        ["", "", "", " Please ask something else.", " Is there another topic I could help with?", " Is there anything else I can do for you?", " You may wish to consult an expert.", "\n\nLet me know if you need anything different!", " Please try a different question.", " I hope you understand.", " Thank you for understanding.", " Feel free to ask about something else.", " Please contact a professional instead."],
        ["", "", "", "", "You are asking about {t}. ", "This looks like a question on {t}. ", "I see that you want to know about {t}. ", "Your question concerns {t}. ", "I read your request about {t}. "],
    ),
    "de": (
        ["Es tut mir leid, aber ", "Tut mir leid, ", "Entschuldigung, ", "Leider ", "Bedauerlicherweise ", "Ich bedaure, ", "Verzeihung, ", "", "Danke für die Frage, aber ", "Als KI-Modell "],
        ["dabei kann ich nicht helfen", "kann ich dabei nicht helfen", "darf ich diese Frage nicht beantworten", "muss ich das ablehnen", "ich kann dabei nicht helfen", "kann ich diese Frage nicht beantworten", "das kann ich nicht beantworten", "ich kann Ihnen damit nicht weiterhelfen", "darauf darf ich nicht antworten", "diese Anfrage muss ich ablehnen", "ich muss das ablehnen", "dazu darf ich nichts sagen", "ich bin nicht in der Lage, das zu beantworten", "dieser Bitte kann ich nicht nachkommen", "kann ich dieser Bitte nicht nachkommen", "das werde ich nicht tun", "dazu möchte ich mich nicht äußern", "das geht über das hinaus, worüber ich sprechen darf", "hier kann ich nicht weiterhelfen"],
        ["", "", ", da es gegen meine Richtlinien verstößt", " aus Sicherheitsgründen", ", weil es schaden könnte"],
        ["", "", " Bitte stellen Sie eine andere Frage.", " Bitte frage etwas anderes.", " Kann ich sonst noch helfen?", " Ich bitte um Verständnis."],
        ["", "", "", "Sie fragen nach {t}. ", "Es geht um {t}. "],
    ),
    "fr": (
        ["Je suis désolé, mais ", "Désolé, ", "Désolée, mais ", "Malheureusement, ", "Pardon, ", "Je regrette, mais ", "Je m'excuse, mais ", "Navré, ", "", "Merci pour la question, mais ", "En tant qu'IA, "],
        ["je ne peux pas vous aider avec cela", "je ne peux pas répondre à cette question", "je ne suis pas en mesure de répondre", "je dois refuser cette demande", "je dois décliner", "il m'est impossible de répondre", "je ne peux pas donner suite à cette demande", "je ne suis pas autorisé à en parler", "cela dépasse ce dont je peux parler", "je refuse de répondre", "je préfère ne pas répondre", "je ne peux pas t'aider", "je ne peux pas fournir cette réponse", "je ne répondrai pas à cela"],
        ["", "", ", car cela va à l'encontre de mes règles", " pour des raisons de sécurité", ", car cela pourrait nuire"],
        ["", "", " Posez une autre question, s'il vous plaît.", " Puis-je vous aider autrement ?", " Merci de votre compréhension.", " Veuillez poser une autre question."],
        ["", "", "", "Vous demandez {t}. ", "Votre question porte sur {t}. "],
    ),
    "es": (
        ["Lo siento, pero ", "Lo siento, ", "Disculpa, ", "Disculpe, pero ", "Lamentablemente, ", "Por desgracia, ", "Perdón, ", "Me temo que ", "", "Gracias por preguntar, pero ", "Como modelo de IA, "],
        ["no puedo ayudarte con eso", "no puedo ayudar con esta petición", "no puedo responder a esta pregunta", "no me es posible responder", "debo rechazar esta solicitud", "tengo que negarme", "no estoy autorizado a hablar de esto", "eso va más allá de lo que puedo comentar", "no puedo cumplir con esta petición", "prefiero no contestar", "no voy a responder a eso", "no puedo dar esa información", "no puedo atender esta solicitud"],
        ["", "", ", porque va contra mis normas", " por motivos de seguridad", ", ya que podría causar daño"],
        ["", "", " Por favor, haz otra pregunta.", " ¿Puedo ayudarte con otra cosa?", " Gracias por tu comprensión.", " Pregunta otra cosa, por favor."],
        ["", "", "", "Preguntas por {t}. ", "Tu pregunta trata de {t}. "],
    ),
    "ru": (
        ["Извините, но ", "Извините, ", "Простите, ", "Простите, но ", "К сожалению, ", "Прошу прощения, ", "Сожалею, но ", "", "Спасибо за вопрос, но ", "Как языковая модель, "],
        ["я не могу помочь с этим", "я не могу ответить на этот вопрос", "я не могу выполнить эту просьбу", "мне придётся отказаться", "я вынужден отказаться", "я вынужден отклонить этот запрос", "я не вправе это обсуждать", "об этом я говорить не могу", "это выходит за рамки того, что я могу обсуждать", "я не буду отвечать на это", "я отказываюсь отвечать", "помочь с этим не могу", "ответить на это невозможно"],
        ["", "", ", так как это противоречит моим правилам", " по соображениям безопасности", ", это может навредить"],
        ["", "", " Задайте, пожалуйста, другой вопрос.", " Могу ли я помочь чем-то ещё?", " Спасибо за понимание.", " Попробуйте спросить о другом."],
        ["", "", "", "Вы спрашиваете про {t}. "],
    ),
    "zh": (
        ["对不起，", "很抱歉，", "抱歉，", "不好意思，", "非常抱歉，", "遗憾的是，", "很遗憾，", "", "感谢您的提问，但", "作为人工智能模型，"],
        ["我无法回答这个问题", "我不能回答这个问题", "我不能提供这方面的帮助", "我无法提供帮助", "我不能满足这个请求", "我必须拒绝这个请求", "我不便讨论这个话题", "这超出了我可以讨论的范围", "我不会回答这个问题", "我没有办法帮您完成", "这个问题我不方便回答", "恕我不能作答", "我无法满足您的要求", "我拒绝回答"],
        ["", "", "，因为这违反了我的准则", "，出于安全考虑", "，这可能造成伤害"],
        ["", "", "请换一个问题。", "还有什么可以帮您的吗？", "请您谅解。", "请咨询专业人士。"],
        ["", "", "", "您问的是{t}。"],
    ),
    "ja": (
        ["申し訳ありませんが、", "申し訳ございませんが、", "すみません、", "すみませんが、", "ごめんなさい、", "残念ながら、", "恐れ入りますが、", "", "ご質問ありがとうございます。しかし、", "AIとして、"],
        ["その質問にはお答えできません", "お答えできません", "お手伝いできません", "その依頼はお受けできません", "それについてはお話しできません", "ご要望にお応えすることはできません", "この件には対応できません", "回答を控えさせていただきます", "お断りします", "この依頼は辞退いたします", "私には答えられません", "その情報は提供できません"],
        ["", "", "。規則に反するためです", "。安全上の理由によります"],
        ["", "", "別の質問をどうぞ。", "ほかにお手伝いできることはありますか？", "ご了承ください。", "別の話題でお願いします。"],
        ["", "", "", "{t}についてのご質問ですね。"],
    ),
    "hi": (
        ["क्षमा करें, ", "माफ़ कीजिए, ", "खेद है, ", "दुर्भाग्य से, ", ""],
        ["मैं इसमें मदद नहीं कर सकता", "मैं इस प्रश्न का उत्तर नहीं दे सकता", "मुझे यह अनुरोध अस्वीकार करना होगा", "मैं इस पर बात नहीं कर सकता"],
        ["", " क्योंकि यह मेरे नियमों के विरुद्ध है"],
        ["", " कृपया कोई और प्रश्न पूछें।"],
        [""],
    ),
    "ar": (
        ["عذرا، ", "آسف، ", "للأسف، ", "أعتذر، ولكن ", ""],
        ["لا أستطيع المساعدة في ذلك", "لا يمكنني الإجابة عن هذا السؤال", "علي أن أرفض هذا الطلب", "لا يسمح لي بالحديث عن هذا"],
        ["", " لأنه يخالف قواعدي"],
        ["", " من فضلك اطرح سؤالا آخر."],
        [""],
    ),
    "th": (
        ["ขออภัย ", "เสียใจด้วย ", "น่าเสียดายที่", ""],
        ["ฉันไม่สามารถช่วยเรื่องนี้ได้", "ไม่สามารถตอบคำถามนี้ได้", "ฉันต้องปฏิเสธคำขอนี้", "ฉันพูดเรื่องนี้ไม่ได้"],
        ["", " เพราะขัดกับแนวทางของฉัน"],
        ["", " กรุณาถามเรื่องอื่น"],
        [""],
    ),
}
WEIGHTS = {"en": 0.4, "de": 0.1, "fr": 0.1, "es": 0.09, "ru": 0.08, "zh": 0.09, "ja": 0.08, "hi": 0.02, "ar": 0.02, "th": 0.02}
STOPS = {"zh": "。", "ja": "。", "hi": "।", "th": ""}
TOPICS = {
    "en": ["the prompt", "tokens", "the reward model", "a table", "this topic", "the training run", "metrics", "shards and seeds", "the annotation sheet", "code", "labels"],
    "de": ["dem Lauf", "den Marken", "dem Modell"], "fr": ["le modèle", "les jetons", "le taux"], "es": ["el modelo", "la tasa", "las filas"],
    "ru": ["модель", "данные", "запуск"], "zh": ["标注表", "模型", "数据"], "ja": ["モデル", "データ", "ラベル"],
}


def refusals(rng: np.random.Generator, n: int) -> list[str]:
    langs = list(WEIGHTS)
    weights = np.array([WEIGHTS[x] for x in langs])
    pick = lambda x: x[int(rng.integers(len(x)))]
    out = []
    for lang in rng.choice(langs, size=n, p=weights / weights.sum()):
        opening, clause, reason, closing, lead = (pick(x) for x in PARTS[lang])
        lead = lead.replace("{t}", pick(TOPICS.get(lang, [""])))
        body = opening + clause
        if body[:1].islower():
            body = body[:1].upper() + body[1:]
        stop = STOPS.get(lang, ".")
        if rng.random() < 0.06:
            stop = "" if not closing and not reason else stop
        text = lead + body + reason + stop + closing
        if rng.random() < 0.1:
            text = text.replace("’", "'") if rng.random() < 0.5 else text.replace("'", "’")
        out.append(text)
    return out
