"""Interpretation texts per test and mode. `{name}` is replaced by the fact of that name.

Each entry is (text when significant, text when not). Correlation and descriptive texts do not depend on p.
"""

TEXTS = {
    ("descriptive", "executive"): (
        "A summary of your data shows: {highlights}. Review the charts for distribution patterns and potential "
        "outliers.", None),
    ("descriptive", "academic"): (
        "Descriptive statistics were computed for all variables. Key findings include: {highlights}. Distribution "
        "normality was assessed via skewness coefficients and Q-Q plots.", None),
    ("descriptive", "simple"): (
        "Here is a summary of your data: {highlights}. Check the histograms and boxplots below to see how each "
        "variable is distributed and whether any unusual values are present.", None),
    ("chi_square", "executive"): (
        "A significant association was found between the two categorical variables ({p_display}). The association "
        "strength is {effect_size} (Cramér's V = {cramers_v}).",
        "No significant association was found between the two categorical variables ({p_display}). "),
    ("chi_square", "academic"): (
        "A chi-square test of independence revealed that the association between the variables was statistically "
        "significant ({apa}). The effect size was {effect_size} (Cramér's V = {cramers_v}), indicating a practically "
        "{effect_size} association.",
        "A chi-square test of independence revealed that the association between the variables was not statistically "
        "significant ({apa}). These findings suggest the variables operate independently in this sample."),
    ("chi_square", "simple"): (
        "There is a statistically significant relationship between your two categorical variables ({p_display}). The "
        "strength of this association is {effect_size} (Cramér's V = {cramers_v}), meaning the link between the "
        "categories is {effect_size} in practice. Check the heatmap to see which specific category combinations are "
        "driving this result.",
        "There is no significant relationship between your two categorical variables ({p_display}). This means "
        "knowing someone's value on one variable does not help predict their value on the other. The two categories "
        "appear to be independent."),
    ("t_test", "executive"): (
        "A significant difference was found between {group_1} (M={mean_1}) and {group_2} (M={mean_2}) ({p_display}). "
        "The effect size is {effect_size} (d={cohens_d}).",
        "No significant difference was found between {group_1} (M={mean_1}) and {group_2} (M={mean_2}) "
        "({p_display}). "),
    ("t_test", "academic"): (
        "An independent samples t-test indicated that the difference between {group_1} (M={mean_1}) and {group_2} "
        "(M={mean_2}) was statistically significant ({apa}). The effect size was {effect_size} (Cohen's d = "
        "{cohens_d}), and the 95% CI for the mean difference was {ci}, suggesting a practically {effect_size} and "
        "statistically reliable difference.",
        "An independent samples t-test indicated that the difference between {group_1} (M={mean_1}) and {group_2} "
        "(M={mean_2}) was not statistically significant ({apa}). These results suggest the two groups perform "
        "similarly on this measure."),
    ("t_test", "simple"): (
        "Your two groups are significantly different ({p_display}). {group_1} scored an average of {mean_1} while "
        "{group_2} averaged {mean_2}. The effect size is {effect_size} (Cohen's d = {cohens_d}), meaning this is a "
        "{effect_size} real-world difference — not just a statistical one. The 95% confidence interval for the gap "
        "is {ci}.",
        "Your two groups are not significantly different ({p_display}). {group_1} scored an average of {mean_1} "
        "while {group_2} averaged {mean_2}. The difference in averages ({mean_difference}) is small enough that it "
        "could easily be due to random chance in your sample."),
    ("anova", "executive"): (
        "Significant differences were found across the {k} groups ({p_display}). Group membership explains "
        "{eta_percent}% of variance (η² = {eta_squared}).",
        "No significant differences were found across the {k} groups ({p_display}). "),
    ("anova", "academic"): (
        "A one-way ANOVA revealed that group differences were statistically significant ({apa}). The effect size "
        "(η² = {eta_squared}) indicates that group membership accounts for a {effect_size} proportion of variance in "
        "the outcome. Bonferroni-corrected post-hoc comparisons identify which specific group pairs differ "
        "significantly.",
        "A one-way ANOVA revealed that group differences were not statistically significant ({apa}). These results "
        "indicate that the groups do not differ significantly on this measure in the present sample."),
    ("anova", "simple"): (
        "There are significant differences between your {k} groups ({p_display}). Group membership explains "
        "{eta_percent}% of the variation in scores (η² = {eta_squared}), which is a {effect_size} effect. Check the "
        "post-hoc table to see exactly which groups are different from each other.",
        "There are no significant differences between your {k} groups ({p_display}). All {k} groups perform "
        "similarly — any differences you see in the chart are likely due to random sampling variation rather than "
        "real group differences."),
    ("correlation", "executive"): (
        "The strongest relationship in your data is between {variable_1} and {variable_2} (r = {r}, {p_display}): a "
        "{strength} correlation. See the heatmap for all variable relationships.", None),
    ("correlation", "academic"): (
        "{method} correlation analysis was conducted across {pairs} variable pair(s). The strongest association was "
        "between {variable_1} and {variable_2} (r = {r}, {p_display}), indicating a {strength} relationship. The "
        "correlation matrix and scatter plots are provided for full inspection.", None),
    ("correlation", "simple"): (
        "Your data shows the strongest connection between {variable_1} and {variable_2}: r = {r} ({p_display}), which "
        "is a {strength} correlation. This means as one goes up, the other tends to go {direction}. The heatmap "
        "shows all relationships at once — the darker the colour, the stronger the link.", None),
    ("regression", "executive"): (
        "Your model successfully predicts {dependent} from {predictors} ({p_display}). It explains {r2_percent}% of "
        "variation in {dependent} (R² = {r_squared}).",
        "Your model does not predicts {dependent} from {predictors} ({p_display}). "),
    ("regression", "academic"): (
        "A {label} was conducted to predict {dependent} from {predictors}. The model was statistically significant "
        "({apa}), explaining {r2_percent}% of variance (R² = {r_squared}, Adj. R² = {adj_r_squared}). The regression "
        "equation is: {equation}. Coefficient significance is reported in the table below.",
        "A {label} was conducted to predict {dependent} from {predictors}. The model was not statistically "
        "significant ({apa}), explaining {r2_percent}% of variance (R² = {r_squared}, Adj. R² = {adj_r_squared}). "
        "These results suggest the selected predictors do not significantly account for variance in {dependent} in "
        "this sample."),
    ("regression", "simple"): (
        "Your model can significantly predict {dependent} using {predictors} ({p_display}). It explains {r2_percent}% "
        "of the variation in {dependent} — meaning {r2_percent}% of what makes {dependent} go up or down is captured "
        "by your predictors. The equation is: {equation}. Check the coefficient table to see which predictors matter "
        "most.",
        "Your model cannot significantly predict {dependent} using {predictors} ({p_display}). Only {r2_percent}% of "
        "the variation in {dependent} is explained, which suggests your predictors may not be the main drivers. "
        "Consider adding other variables or checking the residuals plot."),
    ("mann_whitney", "executive"): (
        "A significant difference was found between {group_1} (Mdn={median_1}) and {group_2} (Mdn={median_2}) "
        "({p_display}).",
        "No significant difference was found between {group_1} (Mdn={median_1}) and {group_2} (Mdn={median_2}) "
        "({p_display})."),
    ("mann_whitney", "academic"): (
        "A Mann-Whitney U test indicated that the difference between {group_1} (Mdn = {median_1}) and {group_2} (Mdn "
        "= {median_2}) was statistically significant ({apa}, r = {effect_r}). This non-parametric test was selected "
        "due to violations of normality.",
        "A Mann-Whitney U test indicated that the difference between {group_1} (Mdn = {median_1}) and {group_2} (Mdn "
        "= {median_2}) was not statistically significant ({apa}, r = {effect_r}). "),
    ("mann_whitney", "simple"): (
        "Using a non-parametric test (which works better when data is not normally distributed), a significant "
        "difference was found between {group_1} (median = {median_1}) and {group_2} (median = {median_2}) "
        "({p_display}). The effect size r = {effect_r} tells us how large this difference is in practice.",
        "Using a non-parametric test (which works better when data is not normally distributed), no significant "
        "difference was found between {group_1} (median = {median_1}) and {group_2} (median = {median_2}) "
        "({p_display}). The two groups appear to have similar distributions."),
    ("kruskal_wallis", "executive"): (
        "Significant differences detected across {k} groups ({p_display}, H = {h_statistic}).",
        "No significant differences detected across {k} groups ({p_display}, H = {h_statistic})."),
    ("kruskal_wallis", "academic"): (
        "A Kruskal-Wallis H test indicated that differences across {k} groups were statistically significant ({apa}). "
        "This non-parametric test was appropriate given the distributional properties of the data.",
        "A Kruskal-Wallis H test indicated that differences across {k} groups were not statistically significant "
        "({apa}). This non-parametric test was appropriate given the distributional properties of the data."),
    ("kruskal_wallis", "simple"): (
        "A Kruskal-Wallis test (a non-parametric version of ANOVA) found significant differences across your {k} "
        "groups ({p_display}). At least one group is meaningfully different from the others. Check the boxplot to see "
        "which groups stand apart.",
        "A Kruskal-Wallis test (a non-parametric version of ANOVA) found no significant differences across your {k} "
        "groups ({p_display}). All {k} groups have similar distributions — any visible differences in the chart are "
        "within normal sampling variation."),
}
MODES = ["simple", "academic", "executive"]
