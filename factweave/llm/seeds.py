"""Example lines from which the residue models start, by kind; ▢ is an open slot.

They are written for this module, or are wordings that servers, browsers and page builders show everywhere. The
models go on with what they find in the corpus.
"""

NOTICE = """
Your browser has JavaScript turned off. Turn on JavaScript in your browser to view this site.
Sorry, but this app doesn't work properly without JavaScript enabled. Please enable it to continue.
We're sorry, this website requires JavaScript to function. Please enable scripts, then refresh the page.
JavaScript must be enabled in order for you to use this form. However, it seems JavaScript is either disabled or not supported by your browser.
This content needs JavaScript to be displayed. Allow scripts for this domain and reload.
Scripts are blocked. Allow scripting in the settings of your browser, then press reload to see the contents.
It looks like scripting is off or unavailable in your browser. Nothing will be shown here without scripts.
For full functionality of this site it is necessary to enable JavaScript. Here are the instructions how to enable JavaScript in your web browser.
<noscript>This website needs JavaScript. Enable JavaScript to run the app.</noscript><div id="app"></div><div id="root"></div>
<noscript><p class="notice">JavaScript is required.</p><img height="0" width="0" style="display:none" src=""/></noscript>
The application cannot be started without JS. The viewer relies on JS. The page stays blank when JS is off.
Checking if the site connection is secure. Verify you are human by completing the action below.
One moment, please. Checking your browser before accessing this website. This process is automatic. You will be redirected shortly.
Enable cookies and JavaScript and turn off any ad blocker to proceed. Please stand by while your request is being verified.
Loading, one moment... Loading... If nothing appears after a while, please check that scripts are permitted and disable blockers.
This browser is out of date and no longer supported. Please update or switch to a modern browser with scripting switched on.
Bitte JavaScript einschalten, um diese Webseite anzuzeigen. Ihr Browser unterstützt kein JavaScript oder JavaScript ist deaktiviert. Diese Seite benötigt JavaScript. Ohne aktivierte Skripte kann der Inhalt nicht dargestellt werden.
Merci d'activer JavaScript dans votre navigateur afin d'afficher cette page. JavaScript est désactivé. Ce site nécessite JavaScript pour fonctionner. Sans scripts, rien ne peut être affiché.
Habilite JavaScript en su navegador para ver esta página. JavaScript está desactivado. Esta aplicación necesita JavaScript para funcionar. Active los scripts y vuelva a cargar.
JavaScriptを有効にしてください。このサイトを表示するにはJavaScriptが必要です。お使いのブラウザではJavaScriptが無効になっています。
请开启JavaScript。此页面需要启用 JavaScript 才能显示。您的浏览器已禁用 JavaScript，请启用脚本后刷新。
"""

ERROR = """
404 Not Found
nginx
404 Not Found
openresty/0.0.0
403 Forbidden
nginx/0.0.0
500 Internal Server Error
nginx
502 Bad Gateway
nginx/0.0.0
502 Bad Gateway
openresty
Error 502
Bad Gateway
HTTP 502 Bad Gateway
503 Service Unavailable
haproxy/0.0
503 Service Temporarily Unavailable
nginx
504 Gateway Time-out
nginx
504 Gateway Timeout
<h1>502 Bad Gateway</h1>
<h1>503 Service Unavailable</h1>
Error 404: the requested URL was not found on this server. That's all we know.
404 - File or directory not found. The resource you are looking for might have been removed, had its name changed, or is temporarily unavailable.
Oops! That page can't be found. It looks like nothing was found at this location. Go to the home page.
Sorry, we couldn't find that page. The link you followed may be broken, outdated, or the page may have been removed or moved.
The item you requested does not exist, has expired or was deleted. It is no longer here. Ask the owner if it was moved elsewhere.
403 Forbidden. You don't have permission to access this resource. Access is denied. You are not authorized to view this item.
HTTP Error 403. Access denied. You need permission. Request access, or switch to an account with access.
401 Unauthorized. Authentication required. Your session timed out. You have been signed out. Please log in again to continue.
Log in to continue. You must be logged in to view this page. Username Password Remember me [ Log in ] Lost your password? Create account
400 Bad Request. Your browser sent a request that this server could not understand. Invalid request.
405 Method Not Allowed. 408 Request Timeout. 409 Conflict. 410 Gone. 413 Payload Too Large. 429 Too Many Requests. Please slow down and retry after 0 seconds.
500 Internal Server Error. The server encountered an internal error or misconfiguration and was unable to complete your request. Please contact the server administrator.
HTTP 500. The website is unable to display the page. An error occurred while processing your request. Request ID: 0. Trace id: 0
Something went wrong. An unexpected error has occurred on our end. Our team has been notified. Please try again in a few minutes. If the problem persists, contact support.
502 Bad Gateway. The server received an invalid response from an upstream server. nginx/0.0.0 Apache/0.0.0 openresty cloudflare
503 Service Temporarily Unavailable. The server is temporarily unable to service your request due to maintenance downtime or capacity problems. Please try again later.
The service is down for scheduled maintenance. We will be back soon. We are currently performing maintenance.
504 Gateway Time-out. The gateway did not receive a timely response from the upstream server. The back end took too long to answer.
<html><head><title>404 Not Found</title></head><body><center><h1>404 Not Found</h1></center><hr><center>nginx/0.0.0</center></body></html>
<!DOCTYPE html><html><head><title>500 Internal Server Error</title></head><body><h1>Internal Server Error</h1><p>Please try again later.</p><hr><address>Server at example Port 0</address></body></html>
{"error": {"code": 404, "message": "not found", "status": "NOT_FOUND"}} {"status": 500, "error": "Internal Server Error", "message": "unexpected error", "path": "/0", "timestamp": 0}
This site can't be reached. The server took too long to respond. The server IP address could not be found. DNS_PROBE_FINISHED ERR_CONNECTION_REFUSED ERR_CONNECTION_TIMED_OUT CONNECTION_RESET
Unable to connect. The connection was reset while the page was loading. The connection to the server was refused, interrupted or closed unexpectedly. Check your internet connection and your proxy.
Secure connection failed. Your connection is not private. The certificate has expired.
Server Error in '/' Application. Runtime Error. An unhandled exception occurred during the execution of the current web request. Stack trace: at Render() at Invoke() in line 0 Version Information: 0.0
Failed to load the document. The file could not be opened. Preview is not available. Export failed. Rendering the content failed (0). The attachment is missing. The image cannot be displayed. The content could not be loaded. Reload to try again.
This page is unavailable. This report could not be generated. The dashboard is currently unavailable. The run was removed. The record has been deleted or archived. The address you entered is wrong; check the spelling and try again.
If you believe this is a mistake, let the administrator know. Quote the reference number 0 (code 0). Host: example. Time: 0:0. Ask your administrator to grant you access. If this happens again, tell the people who run the site.
Seite nicht verfügbar. Fehler 404. Die gesuchte Seite wurde nicht gefunden oder wurde verschoben. Kein Zugriff. Sie haben keine Berechtigung für diese Seite. Ein unerwarteter Fehler ist aufgetreten. Versuchen Sie es später erneut. Der Dienst ist zurzeit nicht erreichbar. Diese Adresse existiert nicht. Zurück zur Startseite.
Erreur 404. La page demandée n'existe pas ou a été déplacée. Accès interdit. Vous n'avez pas l'autorisation d'accéder à cette page. Une erreur est survenue. Réessayez plus tard. Le service est momentanément indisponible. Revenir à la page d'accueil.
Error 404. La página que busca no existe o se ha movido. No tiene permiso para acceder. Se ha producido un error inesperado. Vuelva a intentarlo más tarde. El servicio no está disponible. Volver al inicio.
404エラー。指定されたページが見つかりませんでした。ページは移動または削除された可能性があります。アクセスが拒否されました。サーバーエラーが発生しました。しばらくしてからもう一度お試しください。
您访问的页面不存在或已被删除。找不到页面。没有访问权限。服务器发生错误，请稍后再试。返回首页。
"""

FILLER = """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam.
Nam libero tempore, cum soluta nobis est eligendi optio cumque nihil impedit quo minus id quod maxime placeat facere.
Curabitur pretium tincidunt lacus, nulla gravida orci a odio, nullam varius, turpis et commodo pharetra.
This text is a placeholder. Dummy text goes here. Your content here. Insert text here. Text will be added later. Content to come. Text coming soon. Text follows. More to follow.
Sample paragraph. Example text. To be written later. To be filled in. Nothing here yet. Page under construction. More text, more filler text, yet more text.
blah blah blah blah yadda yadda asdf asdf jkl; qwerty qwerty uiop foo bar baz qux foobar zxcv hjkl test test test 0 0 0 testing testing one two three xyz xyz
asdfasdf qwerqwer zxcvzxcv jkljkl foobarfoo testtesttest blablabla xxyyzz aaa bbb ccc
Platzhaltertext. Blindtext. Dieser Text ist nur ein Platzhalter. Hier kommt später Text hin. Hier steht später der Text.
Ceci est un texte d'exemple. Texte factice. Le texte viendra ici. Texto de relleno. Aquí va el texto. Este es un texto de muestra.
ここに文章が入ります。サンプルテキスト。ダミーテキストです。此处为占位文字。示例文本。
"""

TEMPLATE = """
▢
▢ ▢
▢, ▢ ▢
- ▢
- ▢: ▢
* ▢
0. ▢
> ▢
| ▢ | ▢ | ▢ |
| ▢ | ▢ | ▢ | ▢ |
|---|---|---|
| Name | Value | Owner | Count |
Name: ▢
Date: ▢
Signed: ▢
Owner: ▢ ▢
Hi ▢, thanks for ▢. Please find ▢ in ▢. Your ▢ is due on ▢.
Dear ▢, the ▢ ▢ of ▢ reported ▢ new and ▢ old. Open ▢ to see the list. Best regards, ▢
▢ was changed from ▢ to ▢ by ▢ at ▢.
Please describe the problem in your own words. Briefly describe the goal. Describe how it was found. Explain why this is needed. Explain the reason in one paragraph. Remove this text before you submit. Delete this hint when you are done. Remove sections that don't apply.
Replace this text with your summary. Replace the examples below with your own. Write a brief overview here. Write your answer here. Type here. Enter a title. Enter the details. Click here to edit. Add your text. Add a comment. Add details here. Fill out this part. Fill in every field. Provide steps so that others can reproduce it. List what is affected, one item per line. List the people involved. Name the person responsible. State what you expected to happen. State what happened instead. Link to the ticket. Insert a link. Attach a screenshot. Keep this short, one or two lines. Who noticed, and when? What was done? Use bullet points.
# New page
# Untitled
# Document 0
New document 0
Untitled page 0
- Item 0
- First item
- Point 0
Option 0
"""

FRAME = """
Home | News | Shop | Help | Log in
Home | Docs | Blog | Search | Sign up
Skip to content
Skip to navigation
Search
Menu
Navigation
☰ Menu
☰ Menu   Search
You are here: Home > Section > Page
Wiki > Space > Page
Privacy policy | Terms of use | Imprint | Contact
Print | Share | Report a problem
Powered by the site engine
Powered by wiki software
Last updated: 0
Last modified: never
Back to top
Back to the start page
Go to home page
We use cookies to improve this site. Accept all | Reject all | Only necessary
All rights reserved. Copyright 0
Contact us
Contact the author of this page
Please enable JavaScript to view the comments powered by the comment service.
Comments are loading. Comments could not be loaded.
Page 0 of 0
Edited by ▢
"""
