"""Prompt wording that must be the same byte for byte."""

SYSTEM_PROMPT = """You are an expert text debiaser. Your task is to transform biased sentences into neutral, unbiased versions.

CRITICAL INSTRUCTIONS:
- Output ONLY the unbiased sentence
- Do NOT include any thinking process, reasoning, or explanations
- Do NOT use tags like <think>, <reasoning>, or similar
- Do NOT write "Here's the unbiased version:" or any preamble
- Do NOT add commentary, notes, or justifications
- Start your response directly with the neutral sentence

REMEMBER: Your entire response should be ONLY the neutral sentence. Begin your response immediately with the unbiased version."""

TRAINING_PROMPT = "You are an expert at text style transfer. Your task is to transform text from biased to neutral."

# User turns; "{text}" is the source text.
TRAINING_USER = TRAINING_PROMPT + ":\nBiased text: {text}"
INFERENCE_USER = "Make this neutral: {text}"
TEACHER_USER = "Debias this sentence: {text}"

JUDGE_SYSTEM = """
You are an expert evaluator of bias-neutralization systems.

Given a biased input, a model's neutralized output, and a human reference neutral text,
evaluate the model output on five metrics.
Each score should be an integer from -3 (extremely poor) to 3 (excellent).

Note: The reference neutral text may not always be perfect.
If the reference contains slight imperfections or inconsistencies,
you should still provide fair and independent judgments for each metric
based primarily on the model output's own quality.

Return your response as strict JSON with:
- A numeric score for each metric
- Include one short and concise "overall_reasoning" sentence summarizing the overall assessment if it is overwhelmingly positive or negative.

Metrics to score (-3 to 3):
1. Neutrality — How well does the text remove subjective or biased language?
2. Meaning Preservation — Does it retain the factual meaning of the biased text?
3. Fluency & Coherence — Is it grammatically correct and natural?
4. Edit Minimality — Does it make only necessary changes to achieve neutrality?

"""

JUDGE_USER = """
        BIAS INPUT:
        {biased}

        MODEL OUTPUT:
        {output}

        REFERENCE (human neutral text):
        {reference}
        """

RANK_SYSTEM = """
You are an expert judge in evaluating text debiasing.

Your task is to rank multiple model-generated responses based on their effectiveness in removing bias from the original biased sentence while preserving the intended meaning.

For multiple responses, provide a ranking from best to worst. Each response has a unique id. Your output should be a JSON object with:
- "sentences": A list of objects, each containing:
    - "id": The same unique identifier of the response.
    - "text": The model-generated response text you are ranking.
    - "rank": An integer representing the rank (0 for best, increasing for worse).
- "overall_reasoning": A concise SINGLE sentence summarizing the overall assessment.

When ranking, consider the following criteria:
1. Neutrality: How effectively does the response eliminate biased language?
2. Meaning Preservation: Does the response retain the original meaning of the biased text?
3. Fluency & Coherence: Is the response grammatically and syntactically correct as well as natural-sounding?
4. Edit Minimality: Does the response make only necessary changes to achieve neutrality?

Ensure your rankings are fair and unbiased, focusing solely on the quality of the responses in relation to the biased input.
"""

RANK_USER = """
    The following is a biased text sample from a research dataset used to train bias detection models:

    Original biased text: "{text}"

    Task: Rank the following debiased responses from best (0) to worst (N) based on how well they remove bias while preserving meaning.

    Responses to evaluate:
    {responses}"""

# One candidate in the ranking prompt, and how a list of them is written.
RANK_CANDIDATE = "SentenceWithRank(id={id}, rank={rank}, text={text})"

COT_STYLE = "Neutral, unbiased"

COT_USER = """
You are an expert at text style transfer. Your task is to transform text from one style to another. First, explain your reasoning about what needs to be changed, then provide the transformed text.
Output Format

    Provide reasoning about the style elements that need to be changed
    Mark your final transformed text with [Transferred]:

Example 1: Informal → Formal
Source Text: "hey can u help me out with this thing?"
Target Style: formal

The original text is informal. The use of "hey" is a casual greeting, "u" is text speak for "you", "help me out" is casual phrasing, and "this thing" is vague. To make it formal, I need to use proper greetings, complete words, professional language, and be more specific.

[Transferred]: Excuse me, could you please assist me with this matter?


Example 2: Toxic → Non-toxic
Source Text: "you're such an idiot, this is completely wrong"
Target Style: non-toxic

The original text contains a personal insult ("you're such an idiot") and harsh language ("completely wrong"). To detoxify this, I need to remove the personal attack, soften the criticism, and focus on the issue rather than attacking the person.

[Transferred]: I don't think this approach is correct. Could we reconsider this?

Example 3: Complex → Simple
Source Text: "The implementation necessitates a comprehensive evaluation of the multifaceted parameters."
Target Style: simple

The original text uses complex vocabulary and sentence structure. "Implementation necessitates" can be simplified to "we need to", "comprehensive evaluation" to "look at", and "multifaceted parameters" to "different factors". The overall sentence structure should be more straightforward.

[Transferred]: We need to look at all the different factors.

Now transform this text:
Source Text: "{text}"
Target Style: {style}


"""
